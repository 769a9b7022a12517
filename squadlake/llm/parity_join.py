"""Similarity self-join on word n-grams by parity sketches.

A document's set of n-gram hashes is XORed into a bit sketch cut into P parts.
Each n-gram on one side only flips one bit, so the number of parts that differ is
at most the Hamming distance, and that is at most the symmetric difference: at
similarity t two sets of sizes a and b differ in at most D = (1-t)/(1+t) (a+b)
n-grams.  Hence two linked documents agree in all but D parts, and each must hold
one of the other's keys among its own D + 1 rarest non-empty parts (pigeonhole).
Sizes fall into bands that fix P; a document near a band's lower end also joins
the band below.  A document with D or fewer non-empty parts offers them all and
the band's common key, so the guarantee has no exception.

"Rarest" is any order all documents share: all keys are counted, and the most
frequent ones, a list of bounded length, come last.  Thus passages that many
documents hold make no candidates.

Equal sets are one class from the start.  Groups of documents with one key are
not paired off: each is first compared with one leader, then with those still in
other components only, which leaves no pair of different components untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.bloom import bloom_of, may_hold
from squadlake.llm.components import components
from squadlake.llm.keygroups import shared_keys
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import INK_BYTES, SpanHasher, column_of, mix, shingle_sets, spans_of, text_chunks

NGRAM = 5
PERCENT = 80  # linked when 100 * intersection >= PERCENT * union
BAND_RATIO = 3
MAX_FREQUENT = 1 << 20  # keys in the list of frequent ones: 9 MB
TOP_COUNT = 4096  # counts from here on are alike
KEY_BITS = np.uint64(58)
MOST_TIMES = 63  # of a key in one word, beside its bits
COMBINED_KEYS = 1 << 20  # that a task holds to add them up
SKETCH_WORDS = 32  # 2048 bits: tells sets of up to some thousand n-grams apart
SET_ROWS = "64"  # of an Arrow batch: a long document's set takes some hundred kilobytes
BLOCK_SETS = 2048  # of one key that meet in a task
SALT_ROWS = 2000  # sets compared with one copy of a leader's


class Bands:
    """Bands of set sizes, their part counts and the bounds on differences."""

    def __init__(self, percent: int):
        self.percent = percent
        tops = [2 * BAND_RATIO]
        while tops[-1] < 1 << 40:
            tops.append(tops[-1] * BAND_RATIO)
        self.tops = np.array(tops)  # band j holds sizes under tops[j]
        self.parts = self.tops // 2

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes, "right")

    def smallest_partner(self, sizes: np.ndarray) -> np.ndarray:
        return -(-sizes * self.percent // 100)

    def differences(self, sizes: np.ndarray, as_larger: bool) -> np.ndarray:
        """The most n-grams in which a partner can differ: the larger partner of a
        set has at most size * 100 / percent."""
        partner = sizes if as_larger else sizes * 100 // self.percent
        return (sizes + partner) * (100 - self.percent) // (100 + self.percent)


def band_keys(sets: np.ndarray, firsts: np.ndarray, band: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty parts of each set's sketch, and each set's first key."""
    sizes = np.diff(firsts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part = ((sets >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64)) >> np.uint64(32)
    edge = np.ones(len(sets), dtype=bool)
    edge[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    content = np.bitwise_xor.reduceat(mix(sets + np.uint64(1)), at)
    place = (np.repeat(band, sizes)[at].astype(np.uint64) << np.uint64(48)) ^ part[at]
    return mix(content ^ mix(place)) >> np.uint64(64 - KEY_BITS), np.searchsorted(owner[at], np.arange(len(sizes) + 1))


def subset(sets: np.ndarray, firsts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(firsts)[chosen]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return sets[np.repeat(firsts[:-1][chosen] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _sketches(sets: np.ndarray, firsts: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For own bands, then for the bands below that hold possible smaller partners:
    the documents, their bands, differences, keys and first keys."""
    sizes = np.diff(firsts)
    own, below = bands.of(sizes), bands.of(bands.smallest_partner(sizes))
    for chosen, band, as_larger in ((np.flatnonzero(sizes > 0), own, False), (np.flatnonzero((sizes > 0) & (below < own)), below, True)):
        if len(chosen):
            part_sets, part_firsts = subset(sets, firsts, chosen)
            keys, key_firsts = band_keys(part_sets, part_firsts, band[chosen], bands.parts[band[chosen]])
            yield chosen, band[chosen], bands.differences(sizes[chosen], as_larger), keys, key_firsts


def set_hashes(sets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sizes = np.diff(firsts)
    total = np.concatenate([[0], np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]).astype(np.uint64)
    names = mix((total[firsts[1:]] - total[firsts[:-1]]) + sizes.astype(np.uint64))
    names[sizes == 0] = 0
    return names


def _scanned(batches: Iterator[pa.RecordBatch], ngram: int):
    hasher = SpanHasher(fold_case=True)
    for batch in batches:
        doc_ids = column_of(batch, "doc_id").cast(pa.int64())
        for low, high, data, offsets in text_chunks(column_of(batch, "text")):
            starts, ends, firsts = spans_of(data, offsets, INK_BYTES)
            sets, set_firsts = shingle_sets(hasher.spans(data, starts, ends), firsts, ngram)
            names = set_hashes(sets, set_firsts)
            own = doc_ids.slice(low, high - low)
            copies = mix(names ^ mix(own.fill_null(-1).to_numpy().view(np.uint64)))
            yield own, sets, set_firsts, names, copies


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()],
                                      names=list(columns))


def describe(docs: DataFrame, ngram: int) -> DataFrame:
    """A row per document: doc_id, n_shingles, name of its set, name of the copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, firsts, names, copies in _scanned(batches, ngram):
            yield _batch(doc_id=own, n_shingles=np.diff(firsts), name=names, copy=copies)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, name long, copy long")


def combined(keys: np.ndarray) -> np.ndarray:
    """Each key beside its number in one word, key << 6 | times; what goes beyond
    MOST_TIMES is in further words of that key."""
    keys, times = np.unique(keys, return_counts=True)
    words = 1 + (times - 1) // MOST_TIMES
    out = np.full(words.sum(), MOST_TIMES, dtype=np.uint64)
    out[np.cumsum(words) - 1] = times - MOST_TIMES * (words - 1)
    return np.repeat(keys << np.uint64(64 - KEY_BITS), words) | out


def key_counts(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(key, times) of all sketches' keys that occur more than once.  Tasks add up
    what they hold of a key before the shuffle; one word a key is shuffled and
    streams by in order, so a frequent key takes no memory."""
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held, size = [], 0
        for _, sets, firsts, _, _ in _scanned(batches, ngram):
            for _, _, _, keys, _ in _sketches(sets, firsts, bands):
                held.append(keys)
                size += len(keys)
            if size >= COMBINED_KEYS:
                yield _batch(word=combined(np.concatenate(held)))
                held, size = [], 0
        if held:
            yield _batch(word=combined(np.concatenate(held)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            if not len(words):
                continue
            keys = words >> np.uint64(64 - KEY_BITS)
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            times = np.add.reduceat((words & np.uint64(MOST_TIMES)).astype(np.int64), at)
            keys = keys[at]
            if last == keys[0]:
                times[0] += seen
            elif last is not None and seen > 1:
                yield _batch(key=np.array([last]), times=np.array([seen]))
            last, seen = keys[-1], times[-1]
            many = times[:-1] > 1
            yield _batch(key=keys[:-1][many], times=times[:-1][many])
        if seen > 1:
            yield _batch(key=np.array([last]), times=np.array([seen]))

    words = docs.select("doc_id", "text").mapInArrow(every, "word long")
    key = F.shiftrightunsigned("word", int(64 - KEY_BITS))
    return words.repartition(key).sortWithinPartitions("word").mapInArrow(count, "key long, times long")


def frequent_keys(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys in order and the logarithms of their counts: all keys
    from the least count on at which no more than MAX_FREQUENT remain."""
    sizes = counts.groupBy(F.least("times", F.lit(TOP_COUNT)).alias("times")).agg(F.count("*").alias("n")).toArrow().sort_by([("times", "descending")])
    fits = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) <= MAX_FREQUENT)
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    least = sizes.column("times").to_numpy()[fits[-1]]
    often = counts.where(F.col("times") >= int(least)).toArrow().sort_by("key")
    return often.column("key").to_numpy().view(np.uint64), (1 + np.log2(often.column("times").to_numpy())).astype(np.uint8)


def rare_keys(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], ngram: int, percent: int) -> DataFrame:
    """(key, name) of each set's D + 1 rarest parts in each of its bands."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        often, ranks = shipped.value
        mask = (np.uint64(1) << KEY_BITS) - np.uint64(1)
        for _, sets, firsts, names, _ in _scanned(batches, ngram):
            for chosen, band, differences, keys, key_firsts in _sketches(sets, firsts, bands):
                if len(often):
                    at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
                    keys = keys | np.where(often[at] == keys, ranks[at].astype(np.uint64) << KEY_BITS, np.uint64(0))
                out, owners = [], []
                for i, (a, b, d) in enumerate(zip(key_firsts[:-1].tolist(), key_firsts[1:].tolist(), differences.tolist())):
                    own = keys[a:b]
                    if b - a > d + 1:
                        own.sort()
                        own = own[:d + 1]
                    out.append(own)
                    owners.append(len(own))
                    if b - a <= d:
                        out.append(mix(np.array([band[i]], dtype=np.uint64)))
                        owners[-1] += 1
                yield _batch(key=np.concatenate(out) & mask, name=np.repeat(names[chosen], owners))

    return docs.select("doc_id", "text").mapInArrow(run, "key long, name long")


def bit_sketches(sets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(sets, words) sketches of fixed length: each n-gram flips one bit."""
    out = np.zeros((len(firsts) - 1, SKETCH_WORDS), dtype=np.uint64)
    place = mix(sets ^ np.uint64(0x3C79AC492BA7B653))
    word = (place >> np.uint64(6)).astype(np.int64) % SKETCH_WORDS
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(out)), np.diff(firsts)), word), np.uint64(1) << (place & np.uint64(63)))
    return out


def chosen_sets(docs: DataFrame, copies: DataFrame, n_copies: int, ngram: int, content: str) -> DataFrame:
    """(name, size, and ``content``: sketch or grams) of the documents named in
    ``copies`` (name, copy).  What the Bloom filter or a repeated row adds is another
    copy of the same set, one for each task at most, and does no harm."""
    shipped = docs.sparkSession.sparkContext.broadcast(bloom_of(copies, "copy", n_copies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shipped.value, set()
        for _, sets, firsts, names, own in _scanned(batches, ngram):
            hit = np.flatnonzero(may_hold(bits, own) & (np.diff(firsts) > 0))
            hit = np.array([i for i in hit.tolist() if names[i] not in done and not done.add(names[i])], dtype=np.int64)
            if not len(hit):
                continue
            if content == "sketch":
                words = bit_sketches(*subset(sets, firsts, hit)).reshape(-1).view(np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(words))
            else:
                grams, ends = subset(sets, firsts, hit)
                values = pa.Array.from_buffers(pa.large_binary(), len(hit), [
                    None, pa.py_buffer(8 * ends.astype(np.int64)), pa.py_buffer(grams.astype("<u8"))]).cast(pa.binary())
            yield _batch(name=names[hit], size=np.diff(firsts)[hit], **{content: values})

    kind = "array<long>" if content == "sketch" else "binary"
    return docs.select("doc_id", "text").mapInArrow(run, f"name long, size long, {content} {kind}")


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link: a Hamming distance above the
    most n-grams in which linked sets can differ rules a pair out."""
    sketches = sketches.dropDuplicates(["name"])
    for side in "uv":
        pairs = pairs.join(sketches.select(F.col("name").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
    flipped = F.aggregate(F.zip_with("u_sketch", "v_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.where((100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size"))
                       & ((100 + percent) * flipped <= (100 - percent) * (F.col("u_size") + F.col("v_size")))).select("u", "v")


def near_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (u > v) under one key, in different components, which sizes and sketches
    allow.  ``members``: key, n (sets under the key), u, label.

    The other pairs are never rows: a key's sketches meet as matrices.  Keys of more
    than BLOCK_SETS sets are cut into blocks, and each two blocks meet in a group.
    """
    blocks = F.ceil(F.col("n") / BLOCK_SETS).cast("int")
    mine = F.pmod(F.xxhash64("u"), blocks).cast("int")
    dealt = members.join(sketches.dropDuplicates(["name"]), F.col("u") == F.col("name")).select(
        "key", "u", "label", "size", "sketch", mine.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "u", "label", "size", "sketch")

    def compare(group: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, name, label, size, sketch = group
        step = max(1, (32 << 20) // (len(name) * SKETCH_WORDS * 8))
        for a in range(0, len(name), step):
            part = slice(a, a + step)
            flipped = np.bitwise_count(sketch[part, None] ^ sketch[None]).sum(axis=2, dtype=np.int64)
            total = size[part, None] + size[None]
            fits = (name[part, None] > name[None]) & (label[part, None] != label[None]) & ((100 + percent) * flipped <= (100 - percent) * total)
            fits &= 100 * np.minimum(size[part, None], size[None]) >= percent * np.maximum(size[part, None], size[None])
            if own[0] != own[-1] or (own != own[0]).any():
                fits &= own[part, None] != own[None]
            x, y = np.nonzero(fits)
            yield name[a + x], name[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None

        def meet() -> Iterator[pa.RecordBatch]:
            for u, v in compare([np.concatenate(column) for column in zip(*held)]):
                if len(u):
                    yield _batch(u=u, v=v)

        for batch in batches:
            key, i, j, own, name, label, size = (batch.column(c).to_numpy() for c in range(7))
            sketch = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(len(key), SKETCH_WORDS)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if a == b:
                    continue
                here = (key[a], i[a], j[a])
                if here != last and held:
                    yield from meet()
                    held = []
                last = here
                held.append([own[a:b], name[a:b], label[a:b], size[a:b], sketch[a:b]])
        if held:
            yield from meet()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough.

    u's sets travel to v's: a task streams v's set and then all it is compared
    with.  Leaders of many pairs are split over salts, with a copy of the set each.
    """
    leaders = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(leaders, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    members = salted.join(sets, F.col("u") == F.col("name")).select("v", "salt", "u", "grams")
    heads = leaders.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(
        sets, F.col("v") == F.col("name")).select("v", "salt", F.lit(None).cast("long").alias("u"), "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = batch.column(2), batch.column(0).to_pylist()
            out: list[tuple[int, int]] = []
            for u, v, grams in zip(us.to_pylist(), vs, batch.column(3)):
                own = np.frombuffer(grams.as_buffer(), "<u8")
                if u is None:
                    head = own
                    continue
                both = np.concatenate([head, own])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    out.append((u, v))
            if out:
                yield _batch(u=np.array([x[0] for x in out]), v=np.array([x[1] for x in out]))

    return members.union(heads).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first()).mapInArrow(
        run, "u long, v long")


def classes(docs: DataFrame, scratch: Scratch, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z folded.  Texts of fewer
    words than ``ngram`` are one n-gram; null, empty and blank texts have none and
    are their own component.  component_id is the least doc_id among all documents
    reachable by links; repeated rows are linked with each other; missing ids are
    never the least one.
    """
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(describe(docs, ngram), "documents")
    counts = scratch.keep(key_counts(docs, ngram, percent), "counts")
    frequent = frequent_keys(counts)
    scratch.drop(counts)
    shared = scratch.keep(shared_keys(rare_keys(docs, frequent, ngram, percent)), "keys")
    names = shared.select("name").distinct()
    copies = scratch.keep(rows.where("name <> 0").join(names, "name", "left_semi").groupBy("name").agg(F.min("copy").alias("copy")), "copies")
    sketches = scratch.keep(chosen_sets(docs, copies, copies.count(), ngram, "sketch"), "sketches")

    def test(pairs: DataFrame) -> DataFrame:
        """Links among the pairs: sketches first, then the sets of those they leave."""
        near = scratch.keep(possible(pairs, sketches, percent), "possible")
        needed = scratch.keep(copies.join(near.select(F.explode(F.array("u", "v")).alias("name")).distinct(), "name", "left_semi"), "needed")
        sets = scratch.keep(chosen_sets(docs, needed, needed.count(), ngram, "grams"), "sets")
        links = scratch.keep(linked(near, sets, percent), "links", SET_ROWS)
        scratch.drop(sets)
        return links

    # First every set with its keys' leaders: of a key's sets the one that shares most
    # of its own keys, as an original does that others were copied from.
    standing = shared.groupBy("name").agg(F.count("*").alias("_shares"))
    rank = F.shiftleft("_shares", 40).bitwiseOR(F.shiftrightunsigned("name", 24))
    leaders = scratch.keep(shared.select("key", "name").join(standing, "name").groupBy("key").agg(
        F.max_by("name", rank).alias("v"), F.count("*").alias("n")), "leaders")
    led = shared.select("key", F.col("name").alias("u")).join(leaders, "key")
    tested = scratch.keep(led.where("u <> v").select("u", "v").distinct(), "pairs")
    links = test(tested)
    labels = scratch.keep(components(links, scratch), "labels")

    # Then, under keys of three sets or more, whatever is still in different components.
    larger = led.where("n > 2").join(labels, F.col("u") == F.col("node"), "left").select("key", "n", "u", F.coalesce("label", "u").alias("label"))
    apart = larger.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key")
    left = scratch.keep(larger.join(apart, "key", "left_semi"), "open")
    pairs = near_pairs(left, sketches, percent)
    done = tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = scratch.keep(pairs.distinct().join(done, ["u", "v"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        labels = scratch.keep(components(links.union(test(pairs)), scratch), "labels")

    placed = rows.join(labels, rows.name == labels.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "name").alias("label"))
    placed = scratch.keep(placed, "placed")
    least = placed.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.where("n_shingles > 0").join(least, "label").select("doc_id", "n_shingles", F.col("least").alias("component_id")).union(
        placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
