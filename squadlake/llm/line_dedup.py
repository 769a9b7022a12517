"""Line deduplication within one edit, or for long lines within a few words, by a
deletion-neighbourhood join.

Two lines within one edit either have a variant in common that lacks one
character at the same place of both (a substitution), or one line is the other
without one character.  All variants of a line are hashed keys, taken from
running sums in time proportional to the line; lines with equal keys are
compared, and of two close lines the later one goes.

Only few lines are near another, so variants are emitted for those only which
share a half with another line of about the same length: one edit leaves the
first or the second half of the shorter line whole.  Equal lines are grouped by
their hashes beforehand and count once.

A key's lines are not paired off: with one character deleted at one place they
are all within one substitution of the earliest, and a line without a character
is within one edit of all from which it comes.

For long lines words are the unit as well: a line of n words may differ from the
shorter one in n // ``words_per_edit`` words, ``word_edits`` at most.  Of k + 1
segments of the shorter line one stays whole under k edits, so lines that share a
segment at fitting places are candidates.  They meet leaders of the segment first,
which takes most near copies out.  What stands seeks among the earlier lines that it
has not met: few lines under a segment are paired off.  Under many, the line that seeks
names k + 1 spans of its own that do not overlap, those which the fewest lines hold
(``chosen_spans``): k edits leave one of them whole, so each line within its bound holds
one.  A passage that many lines share is thus never what they are compared for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.bloom import bloom_of, may_hold
from squadlake.llm.keygroups import BLOCK_KEYS, BLOCK_SCHEMA, KeyBlocks, shared_in_blocks
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import LENGTH, SpanHasher, column_of, mix, text_chunks

MIN_CHARS = 20  # shorter lines are only compared for equality
WORD_EDITS = 2  # words in which a long line may differ, at most
WORDS_PER_EDIT = 16  # words that a line needs for each of them
LEADERS = 2  # rounds in which lines meet one leader of each of their segments
FEW = 8  # lines under a shared segment that are paired off
SPANS = (1, 3)  # words of the spans that a line may be sought by
FRONT, BACK, SEED = 0, 1, 2  # kinds of the keys of a line
SEEKS, SEEN = 1, 2  # what a line does when spans are compared
LAST = np.iinfo(np.int64).max  # the position of documents without an id
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def _values(points: np.ndarray) -> np.ndarray:
    return mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def word_spans(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of code points over a space; ``edges`` break runs too."""
    ink = points > 0x20
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1]
    closes[:-1] &= ~ink[1:]
    first, last = edges[edges < len(points)], edges[edges > 0] - 1
    opens[first], closes[last] = ink[first], ink[last]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def word_bound(words: np.ndarray | int, word_edits: int, words_per_edit: int):
    """Words in which two lines may differ, the shorter one of ``words`` words."""
    return np.minimum(np.maximum(words, 0) // words_per_edit, word_edits)


class Lines:
    """The lines of a chunk of texts: spans of code points with two hashes each."""

    def __init__(self, hasher: SpanHasher, data: np.ndarray, offsets: np.ndarray):
        points, offsets = code_points(data, offsets)
        breaks = np.flatnonzero(points == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        counts = np.diff(np.searchsorted(breaks, offsets)) + 1
        self.firsts = np.concatenate([[0], np.cumsum(counts)])
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.number = np.arange(len(self.text)) - self.firsts[self.text]
        self.points, self.hasher = points, hasher
        values = _values(points)
        self.running = hasher.running(values)
        self.size = self.ends - self.starts
        self.hash = self.spans(self.starts, self.ends)
        second = hasher.running(mix(values ^ _SECOND))
        self.check = mix(hasher.raw_spans(second, self.starts, self.ends) + self.size.astype(np.uint64))
        ink = np.concatenate([[0], np.cumsum(points > 0x20)])
        self.filled = ink[self.ends] > ink[self.starts]
        order = np.lexsort((self.number, self.hash, self.text))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (self.hash[order][1:] == self.hash[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
        self.repeated = np.empty(len(order), dtype=bool)
        self.repeated[order] = again

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.hasher.raw_spans(self.running, starts, ends) + (ends - starts).astype(np.uint64) * LENGTH)

    def half_keys(self, chosen: np.ndarray, shorter: np.ndarray) -> list[np.ndarray]:
        """Keys of both halves as a line of ``shorter`` characters is cut: the front from
        the start (even keys), the back from the end (odd keys)."""
        starts, ends = self.starts[chosen], self.ends[chosen]
        half = shorter // 2
        tag = mix(shorter.astype(np.uint64))
        return [mix(self.spans(starts, starts + half) ^ tag) & ~np.uint64(1), mix(self.spans(ends - (shorter - half), ends) ^ tag) | np.uint64(1)]


    def segment_keys(self, chosen: np.ndarray, word_edits: int, words_per_edit: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) for the segments by which a line meets those within its word bound:
        one is whole, and shifted by no more words than edits lie on either side of it."""
        starts, ends = word_spans(self.points, self.starts)
        running = self.hasher.running(self.spans(starts, ends))
        first = np.searchsorted(starts, self.starts[chosen])
        size = np.searchsorted(starts, self.ends[chosen]) - first
        lines, keys = [chosen[:0]], [self.hash[:0]]
        for k in range(1, word_edits + 1):
            for longer in range(k + 1):
                at = np.flatnonzero(word_bound(size - longer, word_edits, words_per_edit) == k)
                shorter = size[at] - longer
                for j in range(k + 1):
                    tag = mix(shorter.astype(np.uint64) * np.uint64(1024) + np.uint64(j))
                    low, high = first[at] + shorter * j // (k + 1), first[at] + shorter * (j + 1) // (k + 1)
                    for shift in range(max(-j, longer - (k - j)), min(j, longer + (k - j)) + 1):
                        lines.append(chosen[at])
                        keys.append(mix(self.hasher.raw_spans(running, low + shift, high + shift) ^ tag))
        return np.concatenate(lines), np.concatenate(keys)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()],
                                      names=list(columns))


def _positions(doc_ids: pa.Array) -> np.ndarray:
    return doc_ids.cast(pa.int64()).fill_null(LAST).to_numpy()


def line_keys(docs: DataFrame, min_chars: int, word_edits: int, words_per_edit: int) -> DataFrame:
    """Rows (hash, mark, position) for lines, and blocks of the keys of their halves (FRONT,
    BACK) and of segments of long ones (SEED)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = SpanHasher(), KeyBlocks()

        def dealt(least: int) -> Iterator[pa.RecordBatch]:
            for columns in held.blocks(least):
                none = pa.nulls(len(columns["bucket"]), pa.int64())
                yield _batch(hash=none, mark=none, position=none, **columns)

        for batch in batches:
            positions = _positions(column_of(batch, "doc_id"))
            for low, _, data, offsets in text_chunks(column_of(batch, "text")):
                lines = Lines(hasher, data, offsets)
                at = np.flatnonzero(lines.filled)
                none = pa.nulls(len(at), pa.binary())
                yield _batch(hash=lines.hash[at], mark=lines.check[at], position=positions[low + lines.text[at]],
                             bucket=pa.nulls(len(at), pa.int32()), keys=none, names=none, flags=none)
                once = lines.filled & ~lines.repeated
                for shift in (0, 1):
                    at = np.flatnonzero(once & (lines.size >= min_chars + shift))
                    for kind, keys in zip((FRONT, BACK), lines.half_keys(at, lines.size[at] - shift)):
                        held.add(keys, lines.hash[at], kind)
                at, keys = lines.segment_keys(np.flatnonzero(once & (lines.size >= min_chars)), word_edits, words_per_edit)
                held.add(keys, lines.hash[at], SEED)
                yield from dealt(BLOCK_KEYS)
        yield from dealt(1)

    return docs.mapInArrow(run, f"hash long, mark long, position long, {BLOCK_SCHEMA}")


def spots(first: DataFrame) -> DataFrame:
    """A key for (line, position of its first document)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, positions = (column_of(batch, c).to_numpy().view(np.uint64) for c in ("hash", "first"))
            yield _batch(spot=mix(hashes ^ mix(positions)))

    return first.select("hash", "first").mapInArrow(run, "spot long")


def wanted_lines(docs: DataFrame, hashes: np.ndarray, first_spots: np.ndarray) -> DataFrame:
    """The lines that may be repeated or near another; with their text where they
    may be the first one of a line near another."""
    shipped = docs.sparkSession.sparkContext.broadcast((hashes, first_spots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (repeated, near) = SpanHasher(), shipped.value
        for batch in batches:
            ids, ties = column_of(batch, "doc_id").cast(pa.int64()), column_of(batch, "tie")
            positions = _positions(ids)
            for low, _, data, offsets in text_chunks(column_of(batch, "text")):
                lines = Lines(hasher, data, offsets)
                at = np.flatnonzero(lines.filled & (may_hold(repeated, lines.hash) | lines.repeated))
                position = positions[low + lines.text[at]]
                here = may_hold(near, mix(lines.hash[at] ^ mix(position.view(np.uint64)))) & ~lines.repeated[at]
                texts = [lines.points[a:b].tobytes().decode("utf-32-le") if h else None
                         for a, b, h in zip(lines.starts[at].tolist(), lines.ends[at].tolist(), here.tolist())]
                row = pa.array(low + lines.text[at])
                yield _batch(doc_id=ids.take(row), tie=ties.take(row), line=lines.number[at], repeated=lines.repeated[at], hash=lines.hash[at],
                             mark=lines.check[at], position=position, text=pa.array(texts, pa.string()))

    return docs.mapInArrow(run, "doc_id long, tie long, line long, repeated boolean, hash long, mark long, position long, text string")


def variant_keys(points: np.ndarray, hasher: SpanHasher, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """For the places from ``low`` to ``high``: keys of the line without its character
    there as a pattern of that place (odd) and as a string (even); and the whole
    line's key as a string."""
    n = len(points)
    running = hasher.running(_values(points))
    without = np.append(running[:n] + (running[n] - running[1:]) * hasher.inverses[1], running[n:])
    sizes = np.full(n + 1, n - 1, dtype=np.uint64)
    sizes[n] = n
    strings = mix(without + sizes * LENGTH)
    patterns = mix(strings[:n] ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED27)))
    return patterns[low:high] | np.uint64(1), np.unique(strings[low:high] & ~np.uint64(1)), strings[n] & ~np.uint64(1)


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """Blocks of all variants of the lines (hash, text, front, back).  A line that
    shares its front half with another differs from it behind, and the reverse."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = SpanHasher(), KeyBlocks()
        for batch in batches:
            for name, text, front, back in zip(*(column_of(batch, c).to_pylist() for c in ("hash", "text", "front", "back"))):
                points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                n = len(points)
                patterns, strings, whole = variant_keys(points, hasher, 0 if back else (n - 1) // 2, n if front else n // 2 + 1)
                keys = np.concatenate([patterns, strings, [whole]])
                held.add(keys, np.full(len(keys), name), 0)
                yield from (_batch(**columns) for columns in held.blocks(BLOCK_KEYS))
        yield from (_batch(**columns) for columns in held.blocks())

    return lines.select("hash", "text", "front", "back").mapInArrow(run, BLOCK_SCHEMA)


def whole_keys(lines: DataFrame) -> DataFrame:
    """(hash, whole): each line's key as a string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            texts = column_of(batch, "text").to_pylist()
            whole = [variant_keys(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), hasher, 0, 0)[2] for t in texts]
            yield _batch(hash=column_of(batch, "hash"), whole=np.array(whole, dtype=np.uint64))

    return lines.select("hash", "text").mapInArrow(run, "hash long, whole long")


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    front = 0
    while front < len(a) and a[front] == b[front]:
        front += 1
    return a[front + (len(a) == len(b)):] == b[front + 1:]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x20]+", text)


def within_edits(a: list[str], b: list[str], k: int) -> bool:
    if abs(len(a) - len(b)) > k:
        return False
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    a, b = a[front:], b[front:]
    if not k or not a or not b:
        return len(a) <= k and len(b) <= k
    return within_edits(a[1:], b[1:], k - 1) or within_edits(a[1:], b, k - 1) or within_edits(a, b[1:], k - 1)


def close_lines(word_edits: int, words_per_edit: int):
    def close(a: str, b: str) -> bool:
        a, b = words_of(a), words_of(b)
        k = int(word_bound(min(len(a), len(b)), word_edits, words_per_edit))
        return k > 0 and within_edits(a, b, k)

    return close


def span_keys(text: str, hasher: SpanHasher, word_edits: int) -> tuple[int, dict[int, np.ndarray]]:
    """The number of a line's words, and keys of its spans of each size in ``SPANS`` by their
    place.  The empty span stands in for those that a line of less than k + 1 words lacks;
    lines that can be within k of it have it too."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts, ends = word_spans(points, np.zeros(0, dtype=np.int64))
    running = hasher.running(mix(hasher.raw_spans(hasher.running(_values(points)), starts, ends) + (ends - starts).astype(np.uint64) * LENGTH))
    n, keys = len(starts), {}
    for size in SPANS:
        at = np.arange(max(n - size + 1, 0))
        keys[size] = mix(hasher.raw_spans(running, at, at + size) + np.uint64(size) * LENGTH)
    if n <= 2 * word_edits:
        keys[0] = np.zeros(1, dtype=np.uint64)
    return n, keys


def line_spans(lines: DataFrame, word_edits: int) -> DataFrame:
    """Blocks of the keys of all spans of the lines (hash, text, role)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = SpanHasher(), KeyBlocks()
        for batch in batches:
            for name, text, role in zip(*(column_of(batch, c).to_pylist() for c in ("hash", "text", "role"))):
                keys = np.concatenate(list(span_keys(text, hasher, word_edits)[1].values()))
                held.add(keys, np.full(len(keys), name), role)
                yield from (_batch(**columns) for columns in held.blocks(BLOCK_KEYS))
        yield from (_batch(**columns) for columns in held.blocks())

    return lines.select("hash", "text", "role").mapInArrow(run, BLOCK_SCHEMA)


def rarest_spans(n: int, keys: dict[int, np.ndarray], known: dict[int, int], wanted: int) -> list[int]:
    """Keys of ``wanted`` spans of a line of ``n`` words that do not overlap, such that the
    lines that hold them are the fewest in all."""
    if n < wanted:
        return keys[0].view(np.int64).tolist()
    sized = [(size, ks.view(np.int64).tolist()) for size, ks in keys.items() if size]
    cost = [(size, ks, [known.get(k, 0) for k in ks]) for size, ks in sized]
    best = [[(0, None)] * (n + 1)]  # by spans taken and words passed: the sum, and the last span with the words before it
    for taken in range(1, wanted + 1):
        before, row = best[-1], [(float("inf"), None)] * (n + 1)
        for end in range(1, n + 1):
            row[end] = row[end - 1]
            for size, ks, cs in cost:
                if size <= end and before[end - size][0] + cs[end - size] < row[end][0]:
                    row[end] = (before[end - size][0] + cs[end - size], (ks[end - size], end - size))
        best.append(row)
    chosen, end = [], n
    for row in reversed(best[1:]):
        key, end = row[end][1]
        chosen.append(key)
    return chosen


def chosen_spans(lines: DataFrame, word_edits: int, words_per_edit: int) -> DataFrame:
    """(key, a): the rarest spans of each line (hash, text), one more than its bound of words.
    ``known`` has (key, n) of its spans that n lines share; what no other line holds needs no search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for name, text, known in zip(*(column_of(batch, c).to_pylist() for c in ("hash", "text", "known"))):
                shared = {k["key"]: k["n"] for k in known}
                n, keys = span_keys(text, hasher, word_edits)
                chosen = rarest_spans(n, keys, shared, int(word_bound(n, word_edits, words_per_edit)) + 1)
                out += [(key, name) for key in chosen if key in shared]
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield _batch(key=pairs[:, 0].copy(), a=pairs[:, 1].copy())

    return lines.select("hash", "text", "known").mapInArrow(run, "key long, a long")


def led_segments(lines: DataFrame, seeds: DataFrame, scratch: Scratch, close) -> tuple[DataFrame, DataFrame]:
    """Each line meets leaders of its segments, as many pairs as rows: the earliest line,
    then the earliest that stands and has not led.  Returns the hashes (later) of the lines
    gone by that, and the rows (key, name, seeks, seen) to search on: those that stand and come after
    one that has not led seek, and the latter are their witnesses, gone or not."""
    state = seeds.join(lines.select(F.col("hash").alias("name"), F.struct("position", "line", "hash").alias("place")), "name").select(
        "key", "name", "place", F.lit(False).alias("led"), F.lit(False).alias("gone"))
    state, gone = scratch.keep(state, "segments"), lines.where("false").select(F.col("hash").alias("later"))
    for _ in range(LEADERS):
        heads = state.where("not (led or gone)").groupBy("key").agg(F.min("place").alias("head"))
        met = state.join(heads, "key", "left")
        pairs = met.where("not (led or gone) and place > head").select(F.col("name").alias("a"), F.col("head.hash").alias("b"))
        new = scratch.keep(later_of(pairs, lines, close), "led")
        gone = gone.union(new)
        met = met.join(new.select(F.col("later").alias("name"), F.lit(True).alias("_new")), "name", "left")
        leads = F.coalesce(F.col("place") == F.col("head"), F.lit(False))
        state = scratch.keep(met.select("key", "name", "place", (F.col("led") | leads).alias("led"), (F.col("gone") | F.col("_new").isNotNull()).alias("gone")), "segments")
    stands, witness = ~F.col("gone"), ~F.col("led")
    ranges = state.groupBy("key").agg(F.min(F.when(witness, F.col("place"))).alias("low"), F.max(F.when(stands, F.col("place"))).alias("high")).where("low < high")
    roles = state.join(ranges, "key").select("key", "name", (stands & (F.col("place") > F.col("low"))).alias("seeks"), (witness & (F.col("place") < F.col("high"))).alias("seen"))
    return gone, roles.where("seeks or seen").select("key", "name", "seeks", "seen")


def word_repeats(lines: DataFrame, seeds: DataFrame, scratch: Scratch, word_edits: int, words_per_edit: int) -> DataFrame:
    """Hashes of the lines within their word bound of an earlier one; ``lines``: hash, text,
    position, line; ``seeds``: (key, name) of the segments that lines share."""
    close = close_lines(word_edits, words_per_edit)
    gone, left = led_segments(lines, seeds, scratch, close)
    left = scratch.keep(left, "left")
    sized = left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key")
    few = sized.where(F.col("n") <= FEW)
    pairs = few.where("seeks").select("key", F.col("name").alias("x")).join(few.where("seen").select("key", F.col("name").alias("y")), "key").where("x <> y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    role = F.bit_or(F.when(F.col("seeks"), SEEKS).otherwise(0)) + F.bit_or(F.when(F.col("seen"), SEEN).otherwise(0))
    many = sized.where(F.col("n") > FEW).groupBy(F.col("name").alias("hash")).agg(role.alias("role"))
    many = scratch.keep(lines.join(many, "hash").select("hash", "text", "role"), "many")
    if not many.isEmpty():
        spans = scratch.keep(shared_in_blocks(line_spans(many, word_edits)), "spans")
        known = spans.where(F.col("flag").bitwiseAND(SEEKS) > 0).groupBy(F.col("name").alias("hash")).agg(F.collect_list(F.struct("key", "n")).alias("known"))
        chosen = scratch.keep(chosen_spans(many.join(known, "hash"), word_edits, words_per_edit), "chosen")
        seen = spans.where(F.col("flag").bitwiseAND(SEEN) > 0).select("key", F.col("name").alias("b"))
        pairs = pairs.union(chosen.join(seen, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return gone.union(later_of(pairs, lines, close)).distinct()


def close_pairs(pairs: DataFrame, close=within_one_edit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [close(a, b) for a, b in zip(column_of(batch, "a_text").to_pylist(), column_of(batch, "b_text").to_pylist())]
            yield batch.select(["later"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "later long")


def later_of(pairs: DataFrame, lines: DataFrame, close) -> DataFrame:
    """The later line of each of the pairs (a, b) that are close."""
    a, b = (lines.select(F.col("hash").alias(s), F.struct("position", "line", "hash").alias(f"{s}_place"), F.col("text").alias(f"{s}_text")) for s in "ab")
    pairs = pairs.distinct().join(a, "a").join(b, "b")
    return close_pairs(pairs.select("a_text", "b_text", F.when(F.col("a_place") > F.col("b_place"), F.col("a")).otherwise(F.col("b")).alias("later")), close).distinct()


def near_repeats(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Hashes of the lines within one edit of an earlier one; ``lines``: hash, text,
    front, back and the place (position, line) of the first of its kind."""
    keys = scratch.keep(shared_in_blocks(neighbourhoods(lines)).select("key", F.col("name").alias("hash")), "variants")
    places = lines.join(whole_keys(lines), "hash").select("hash", "whole", F.struct("position", "line", "hash").alias("place"))
    placed = keys.join(places, "hash")
    odd = F.col("key").bitwiseAND(1) == 1
    patterns = placed.where(odd)
    heads = patterns.groupBy("key").agg(F.min("place").alias("head")).select("key", F.col("head.hash").alias("b"))
    same_length = patterns.join(heads, "key").where("hash <> b").select(F.col("hash").alias("a"), "b")
    strings = placed.where(~odd)
    whole = strings.where("key = whole").select("key", F.col("hash").alias("b"))
    shorter = strings.where("key <> whole").select("key", F.col("hash").alias("a")).join(whole, "key").select("a", "b")
    return later_of(same_length.union(shorter), lines, within_one_edit)


def dropped_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, word_edits: int = WORD_EDITS,
                  words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, tie, dropped): the numbers of the lines to drop, for documents with any."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    keys = scratch.keep(line_keys(docs.drop("tie"), min_chars, word_edits, words_per_edit), "lines")
    shared = scratch.keep(shared_in_blocks(keys.where("bucket is not null").select("bucket", "keys", "names", "flags")), "shared")
    seeds = shared.where(F.col("flag") == SEED).select("key", "name")
    marked = shared.select("name", *[(F.col("flag") == kind).alias(c) for c, kind in (("front", FRONT), ("back", BACK), ("words", SEED))])
    near = scratch.keep(marked.groupBy(F.col("name").alias("hash")).agg(*[F.bool_or(c).alias(c) for c in ("front", "back", "words")]), "near")
    counted = keys.where("mark is not null").groupBy("hash", "mark").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    counted = counted.join(near.select("hash", F.lit(True).alias("near")), "hash", "left").where("n > 1 or near")
    known = scratch.keep(counted, "known")
    scratch.drop(keys)
    maybe_near = known.where("near")
    n_known, n_near = known.count(), maybe_near.count()
    found = scratch.keep(wanted_lines(docs, bloom_of(known, "hash", n_known), bloom_of(spots(maybe_near), "spot", n_near)), "wanted")
    gone = known.where("false").select(F.col("hash").alias("later"))
    if n_near:
        firsts = found.where("text is not null").join(maybe_near.select("hash", "mark", F.col("first").alias("position")), ["hash", "mark", "position"], "left_semi")
        lines = scratch.keep(firsts.dropDuplicates(["hash"]).join(near, "hash").select("hash", "text", "position", "line", "front", "back", "words"), "texts")
        by_words = word_repeats(lines.where("words"), seeds, scratch, word_edits, words_per_edit)
        gone = scratch.keep(near_repeats(lines.where("front or back"), scratch).union(by_words).distinct(), "gone")
    known = known.join(gone.withColumn("gone", F.lit(True)), known.hash == gone.later, "left").select("hash", "mark", "first", "gone")
    hit = found.drop("text").join(known, ["hash", "mark"], "left").where("repeated or position > first or gone")
    return hit.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("dropped"))


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with the lines named in ``drops`` (of ``dropped_lines``) taken out of
    ``text``, and with n_lines and n_dropped (columns of these names are replaced)."""
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("dropped").alias("_dropped"))
    keyed = docs.drop("n_lines", "n_dropped").withColumn("_text_hash", F.xxhash64("text"))
    joined = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_tie")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_dropped", i.cast("long"))), "\n")
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_dropped": F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long"),
        "text": F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept),
    }).drop("_id", "_tie", "_dropped", "_text_hash")


def without_repeats(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, word_edits: int = WORD_EDITS,
                    words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """``docs`` without repeated and nearly repeated lines, and with n_lines and n_dropped.

    Of equal lines, and of lines of ``min_chars`` characters or more within one
    edit of each other, or within their word bound (one word for every
    ``words_per_edit`` of the shorter line, ``word_edits`` at most, 0 for none), the earliest stays: that of the least doc_id (documents
    without an id come last), then the first in the text.  A line goes if any
    earlier line is close to it, whether that one stays or not.  Blank lines always
    stay.  Rows that share a doc_id stand at one place: a line that two of them
    hold stays in both.  Null texts stay null and have no lines.
    """
    return without_lines(docs, scratch.result(dropped_lines(docs, scratch, min_chars, word_edits, words_per_edit)))
