"""Phrase collocations by stripes.

A stripe is a prefix with an associative counter of the words that follow it.
The stripe of the empty prefix counts words, those of one word count pairs, and so
on.  Each task sums the stripes of its texts, tasks' stripes are merged elementwise
after a shuffle by prefix, and what is left of them (entries counted often enough)
holds everything that is asked: an entry is the phrase "prefix next" and its count,
a prefix's count is its entry one stripe up, and the largest extension of a phrase
is the greatest entry of the stripe it heads or of one whose tail it is.

Level by level, only phrases both of whose ends were frequent are counted: a Bloom
filter of bounded size keeps most others out of the shuffle, and the threshold after
the merge is exact.  Strings, not hashes, meet in the merge.  The stripe of a prefix
that holds over a thousandth of all words (at most a thousand there can be of each
length) is cut into slices by its next words; that of no words always is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squadlake.llm.bloom import bloom_of, may_hold
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import LENGTH, SpanHasher, byte_class, column_of, mix, spans_of, text_chunks

NO_LANG = "und"
_ENDS = [(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)]
PIECE_END = byte_class(*_ENDS)  # [.,;:!?\x0A-\x0D]
WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x09), *_ENDS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
CHUNK = 1 << 20
TASK_ENTRIES = 700_000  # entries a task sums before it passes them on
HOT_SHARE, SLICES, ROOT_SLICES = 1000, 64, 1024
RANK_PARTS = 32
STRIPE = "lang string, prefix string, slice int, nexts string, counts string"  # both lists joined by spaces: half the bytes of arrays


def strings_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes as a string column."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw.tobytes()))


def lang_seed(lang: str) -> np.uint64:
    with np.errstate(over="ignore"):
        seed = np.uint64(len(lang)) * LENGTH
        for byte in lang.encode():
            seed = mix(seed + np.uint64(byte + 1))
    return seed


class Words:
    """The words of some texts as one byte array, each followed by a space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher):
        starts, ends, firsts = spans_of(data, offsets, WORD_BYTES)
        self.n = len(starts)
        sizes = ends - starts + 1
        self.starts = np.cumsum(sizes) - sizes
        self.ends = self.starts + sizes - 1
        self.data = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
        inside = np.ones(len(self.data), dtype=bool)
        inside[self.ends] = False
        self.data[inside] = LOWER[data[WORD_BYTES[data]]]
        ended = np.concatenate([[0], np.cumsum(PIECE_END[data])])
        self.after_break = np.ones(self.n, dtype=bool)  # no phrase goes from the word before into this one
        self.after_break[1:] = ended[starts[1:]] > ended[ends[:-1]]
        self.after_break[firsts[:-1][firsts[:-1] < self.n]] = True
        self.text = np.searchsorted(firsts, np.arange(self.n), "right") - 1
        self.hasher = hasher
        self.running = hasher.running(hasher.values[self.data])

    def phrases(self, k: int) -> np.ndarray:
        """First words of all phrases of k words."""
        n = max(self.n - k + 1, 0)
        whole = np.ones(n, dtype=bool)
        for j in range(1, k):
            whole &= ~self.after_break[j:j + n]
        return np.flatnonzero(whole)

    def hashes(self, first: np.ndarray, k: int) -> np.ndarray:
        a, b = self.starts[first], self.ends[first + k - 1]
        return mix(self.hasher.raw_spans(self.running, a, b) + (b - a).astype(np.uint64) * LENGTH)


class Stripes:
    """Sums of a task's stripes: one entry for each language, prefix and next word."""

    def __init__(self, hot: set[tuple[str, str]], slices: int):
        self.hot, self.slices = hot, slices
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, lang: np.ndarray, keys: np.ndarray, prefixes: np.ndarray, nexts: np.ndarray, counts: np.ndarray,
            prefix_texts: pa.Array, next_texts: pa.Array) -> None:
        self.parts.append((lang, keys, prefixes, nexts, counts, prefix_texts, next_texts))
        self.held += len(keys)

    def merged(self) -> None:
        lang, keys, prefixes, nexts, counts = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
        texts = [pa.concat_arrays([p[i] for p in self.parts]) for i in (5, 6)]
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        summed = np.bincount(which, weights=counts, minlength=len(at)).astype(np.int64)
        self.parts = [(lang[at], keys[at], prefixes[at], nexts[at], summed, texts[0].take(pa.array(at)), texts[1].take(pa.array(at)))]
        self.held = len(at)

    def flush(self, langs: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self.merged()
        lang, _, prefixes, nexts, counts, prefix_texts, next_texts = self.parts[0]
        self.parts, self.held = [], 0
        slices = np.zeros(len(lang), dtype=np.int32)
        own = (nexts >> np.uint64(40)).astype(np.int64)
        if self.hot:
            cut = np.isin(prefixes, prefix_keys(self.hot))
            slices[cut] = own[cut] % self.slices
        elif self.slices:
            slices[:] = own % self.slices
        order = np.lexsort((slices, prefixes))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (prefixes[order][1:] != prefixes[order][:-1]) | (slices[order][1:] != slices[order][:-1])
        heads = np.flatnonzero(new)
        bounds = np.append(heads, len(order))
        for a in range(0, len(heads), 20_000):
            b = min(a + 20_000, len(heads))
            rows, ends = order[bounds[a]:bounds[b]], pa.array(bounds[a:b + 1] - bounds[a], pa.int32())
            head = order[heads[a:b]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in lang[head].tolist()], pa.string()), prefix_texts.take(pa.array(head)).cast(pa.string()), pa.array(slices[head]),
                 pc.binary_join(pa.ListArray.from_arrays(ends, next_texts.take(pa.array(rows)).cast(pa.string())), " "),
                 pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(counts[rows]).cast(pa.string())), " ")],
                names=["lang", "prefix", "slice", "nexts", "counts"])


def prefix_keys(prefixes: set[tuple[str, str]]) -> np.ndarray:
    hasher, found = SpanHasher(), []
    for lang, prefix in prefixes:
        data = np.frombuffer(prefix.encode(), dtype=np.uint8)
        found.append(keyed(np.array([lang_seed(lang)]), hasher.spans(data, np.array([0]), np.array([len(data)]))))
    return np.concatenate(found)


def keyed(seeds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + seeds)


def stripes(docs: DataFrame, k: int, frequent: np.ndarray | None, hot: set[tuple[str, str]]) -> DataFrame:
    """Stripes of prefixes of k - 1 words; of phrases whose first and last k - 1 words may be in ``frequent``."""
    slices = ROOT_SLICES if k == 1 else SLICES if hot else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = SpanHasher(), Stripes(hot, slices)
        langs: dict[str, int] = {}
        for batch in batches:
            names = column_of(batch, "lang").to_pylist()
            own = np.array([langs.setdefault(name, len(langs)) for name in names], dtype=np.int64)
            seeds = np.array([lang_seed(name) for name in langs], dtype=np.uint64)
            for low, high, data, offsets in text_chunks(column_of(batch, "text"), CHUNK):
                words = Words(data, offsets, hasher)
                first = words.phrases(k)
                if not len(first):
                    continue
                lang = own[low:high][words.text[first]]
                seed = seeds[lang]
                heads = keyed(seed, words.hashes(first, k - 1)) if k > 1 else seed
                tails = keyed(seed, words.hashes(first + 1, k - 1)) if k > 1 else seed
                if frequent is not None:
                    some = may_hold(frequent, heads) & may_hold(frequent, tails)
                    first, lang, heads, seed = first[some], lang[some], heads[some], seed[some]
                keys, at, counts = np.unique(keyed(seed, words.hashes(first, k)), return_index=True, return_counts=True)
                if not len(at):
                    continue
                first, last = first[at], first[at] + k - 1
                prefix_ends = words.ends[last - 1] if k > 1 else words.starts[first]
                sums.add(lang[at], keys, heads[at], words.hashes(last, 1), counts,
                         strings_of(words.data, words.starts[first], prefix_ends), strings_of(words.data, words.starts[last], words.ends[last]))
                if sums.held > TASK_ENTRIES:
                    sums.merged()
                    if 2 * sums.held > TASK_ENTRIES:
                        yield from sums.flush(list(langs))
        yield from sums.flush(list(langs))

    return docs.mapInArrow(run, STRIPE)


def merged(parts: DataFrame) -> DataFrame:
    """Elementwise sums of stripes: lang, prefix, next, count.  The shuffle moves whole
    stripes; entries are summed where they land."""
    landed = parts.repartition("lang", "prefix", "slice")
    entries = landed.select("lang", "prefix", "slice", F.explode(F.arrays_zip(F.split("nexts", " ").alias("next"), F.split("counts", " ").alias("n"))).alias("e"))
    return (entries.groupBy("lang", "prefix", "slice", F.col("e.next").alias("next"))
            .agg(F.sum(F.col("e.n").cast("long")).alias("count")).drop("slice"))


def phrase_keys(level: DataFrame) -> DataFrame:
    """Hashes of a level's phrases as tasks compute them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            names = column_of(batch, "lang").to_pylist()
            known = {name: lang_seed(name) for name in set(names)}
            seeds = np.array([known[name] for name in names], dtype=np.uint64)
            for low, high, data, offsets in text_chunks(column_of(batch, "phrase"), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(keyed(seeds[low:high], hasher.spans(data, offsets[:-1], offsets[1:])).view(np.int64))], names=["key"])

    return level.select("lang", "phrase").mapInArrow(run, "key long")


def counted(docs: DataFrame, least: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``least`` times or more (lang,
    prefix, next, phrase, words, count), and all word occurrences by language (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    levels, frequent, hot, totals, n_all = [], None, set(), None, 0
    for k in range(1, longest + 1):
        entries = merged(stripes(texts, k, frequent, hot))
        if k == 1:
            entries = scratch.keep(entries, "words")
            totals = scratch.keep(entries.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
            n_all = totals.agg(F.sum("n")).first()[0] or 0
        often = entries.where(F.col("count") >= least)
        phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
        level = scratch.keep(often.withColumns({"phrase": phrase, "words": F.lit(k)}), f"phrases{k}")
        levels.append(level)
        n_level = level.count()
        if not n_level:
            break
        frequent = bloom_of(phrase_keys(level), "key", n_level)
        hot = {tuple(r) for r in level.where(F.col("count").cast("decimal(20,0)") * HOT_SHARE > n_all).select("lang", "phrase").collect()}
    return reduce(DataFrame.union, levels), totals


def with_counts(rows: DataFrame, part: str, counts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """Add the count of phrase ``part`` as ``name``.  Phrases of ``hot`` (at most a thousand
    for each number of words) may be part of very many others, so they are salted."""
    marks = F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.lit(True).alias("_hot")))
    salted = rows.join(marks, ["lang", part], "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).otherwise(0).cast("int")).drop("_hot")
    copies = counts.join(F.broadcast(hot.select("lang", "phrase", F.lit(True).alias("_hot"))), ["lang", "phrase"], "left").select(
        "lang", F.col("phrase").alias(part), F.col("count").alias(name),
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    return salted.join(copies, ["lang", part, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, scratch: Scratch, least: int = 30, longest: int = 4, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """Scored phrases of (lang, text): lang, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (ties:
    the earliest), ``score`` is floor(scale * a / (l + r)).  Phrases of 2 to ``longest``
    words with ``a`` of ``least`` or more come, but for those inside a longer one that has
    ``share`` percent of their count or more.  A null lang is 'und'; null and empty texts
    have no words; repeated rows count as often.  No words: no rows.
    """
    counts, totals = counted(docs, least, longest, scratch)
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    hot = scratch.keep(counts.where(F.col("count").cast("decimal(20,0)") * HOT_SHARE > n_all).select("lang", "phrase"), "hot")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = phrases.select("lang", "phrase", "a", "_w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice("_w", F.col("cut") + 1, F.col("words")), " ").alias("right"))
    cuts = with_counts(with_counts(cuts, "left", counts, hot, "l"), "right", counts, hot, "r")
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("_best"), F.first("a").alias("a"))
              .select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    # A phrase's largest extension: entries of stripes it heads, and of those whose tail it is.
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    longer = counts.where("words > 2").select("lang", F.col("count").alias("f"), F.explode(F.array("prefix", tail)).alias("phrase"))
    extended = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    inside = F.col("f").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    kept = scored.join(extended, ["lang", "phrase"], "left").where(F.col("f").isNull() | ~inside)
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank; parts of a language are cut first."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    within = parts.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= most)
    ranked = within.drop("_part", "_r").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)
