"""Toxicity by weak supervision.

Voters look at a text and fire or abstain: lexicons of insults by language,
lexicons of words and word beginnings mined from labelled texts, and patterns.
A generative label model estimates from the votes on all documents how often each
voter fires on either class and how voters depend on each other; voters that fire
together beyond what the class explains share their weight.  Its posteriors are
the labels of a logistic regression on single terms, votes and counts, which
gives the score.

Texts are scanned once for the labelled sample that terms are mined from, and
once for all documents; what leaves the second scan are votes and the few terms hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import ALNUM_BYTES, SpanHasher, byte_class, column_of, mix, spans_of, text_chunks

SAMPLE_DOCS = 20_000  # labelled documents that terms are mined and the classifier is fitted on, at most
MAX_TERMS = 400
PREFIXES = (4, 5, 6)  # bytes
LEXICONS = {
    "en": "idiot idiots moron morons stupid loser losers pathetic disgusting worthless scum trash clown dumb imbecile filth vermin",
    "de": "idiot dummkopf vollidiot arschloch abschaum widerlich erbärmlich wertlos trottel dreckig missgeburt",
    "fr": "idiot imbécile crétin connard salaud ordure minable dégoûtant abruti racaille pourriture",
    "es": "idiota imbécil estúpido basura escoria asqueroso patético inútil payaso miserable cabrón",
}
WORD_LEXICONS = 3
VOTERS = (*(f"lexicon_{k}" for k in LEXICONS), *(f"words_{i}" for i in range(WORD_LEXICONS)), *(f"starts_{n}" for n in PREFIXES),
          "several_terms", "dense_terms", "shouting", "capitals")
_SHOUT, _UPPER, _LETTER = byte_class((0x21, 0x21)), byte_class((0x41, 0x5A)), byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def text_terms(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashes of the words and of their beginnings, each with its text; and the words per text."""
    starts, ends, firsts = spans_of(data, offsets, ALNUM_BYTES)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    if not len(starts):
        return [(np.zeros(0, np.uint64), text)] * (1 + len(PREFIXES)), np.diff(firsts)
    running = hasher.running(hasher.values[data])
    found = [(mix(hasher.raw_spans(running, starts, ends)), text)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        found.append((mix(hasher.raw_spans(running, starts[long], starts[long] + n) ^ mix(np.array([n], dtype=np.uint64))), text[long]))
    return found, np.diff(firsts)


def lexicon_hashes(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), dtype=np.uint8)
    return np.unique(text_terms(raw, np.array([0, len(raw)]), SpanHasher(fold_case=True))[0][0][0])


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()],
                                      names=list(columns))


def mined_terms(labelled: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, kind) of the terms that mark toxic texts best in ``labelled`` (text, label);
    kind 0 is a word, others a beginning of PREFIXES[kind - 1] bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(fold_case=True)
        for batch in batches:
            labels = column_of(batch, "label").to_numpy()
            for low, high, data, offsets in text_chunks(column_of(batch, "text"), 4 << 20):
                for kind, (terms, text) in enumerate(text_terms(data, offsets, hasher)[0]):
                    order = np.lexsort((text, terms))
                    terms, text = terms[order], text[order]
                    once = np.ones(len(terms), dtype=bool)
                    once[1:] = (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])
                    distinct, at = np.unique(terms[once], return_inverse=True)
                    toxic = np.bincount(at, weights=labels[low:high][text[once]], minlength=len(distinct)).astype(np.int64)
                    yield _batch(term=distinct, kind=np.full(len(distinct), kind, np.int32), toxic=toxic, n=np.bincount(at, minlength=len(distinct)))

    counts = labelled.mapInArrow(run, "term long, kind int, toxic long, n long").groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    least = max(3, total.toxic // 500)
    rate = (F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5) * ((total.n - total.toxic + 1) / (total.toxic + 1))
    marks = counts.where(F.col("toxic") >= least).withColumn("odds", F.log(rate)).where("odds >= 3")
    return marks.orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(max_terms).select("term", "kind")


def votes(docs: DataFrame, terms: np.ndarray, kinds: np.ndarray) -> DataFrame:
    """(doc_id, votes, hits, n_hits, n_words) per row of ``docs``: bits of the voters
    that fire, indexes of the mined terms hit, and counts.  ``terms`` is sorted."""
    lexicons = [lexicon_hashes(words) for words in LEXICONS.values()]
    groups = np.where(kinds == 0, (terms >> np.uint64(40)).astype(np.int64) % WORD_LEXICONS, WORD_LEXICONS + kinds - 1)
    n_mined = WORD_LEXICONS + len(PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(fold_case=True)
        for batch in batches:
            ids = column_of(batch, "doc_id").cast(pa.int64())
            for low, high, data, offsets in text_chunks(column_of(batch, "text")):
                n = high - low
                found, n_words = text_terms(data, offsets, hasher)
                bits, n_hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i, lexicon in enumerate(lexicons):
                    words, text = found[0]
                    at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
                    bits[text[lexicon[at] == words]] |= 1 << i
                hit_text, hit_term = [], []
                for values, text in found:
                    if len(terms):
                        at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
                        hit = terms[at] == values
                        hit_text.append(text[hit])
                        hit_term.append(at[hit])
                pairs = np.zeros((2, 0), np.int64)
                if hit_text:
                    pairs = np.unique(np.stack([np.concatenate(hit_text), np.concatenate(hit_term)]), axis=1)
                    n_hits += np.bincount(np.concatenate(hit_text), minlength=n)
                for g in range(n_mined):
                    bits[pairs[0][groups[pairs[1]] == g]] |= 1 << (len(lexicons) + g)
                n_terms = np.bincount(pairs[0], minlength=n)
                shout, upper, letters = ([np.add.reduceat(np.append(c[data], 0), offsets[:-1]) * (np.diff(offsets) > 0) for c in (_SHOUT, _UPPER, _LETTER)])
                patterns = (n_terms >= 2, n_hits * 50 >= np.maximum(n_words, 50), shout >= 5, upper * 2 > np.maximum(letters, 20))
                for i, fires in enumerate(patterns):
                    bits |= fires.astype(np.int64) << (len(lexicons) + n_mined + i)
                ends = np.concatenate([[0], np.cumsum(n_terms)]).astype(np.int32)
                yield _batch(doc_id=ids.slice(low, n), votes=bits, hits=pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[1])), n_hits=n_hits, n_words=n_words)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes long, hits array<long>, n_hits long, n_words long")


@dataclass(frozen=True)
class LabelModel:
    """P(class), P(voter fires | class) and the voters' weights."""

    prior: float
    fires: np.ndarray  # (2, voters)
    weights: np.ndarray

    @classmethod
    def fit(cls, bits: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
        """Expectation maximisation over the distinct vote patterns ``bits`` (patterns,
        voters) with their ``counts``, from firing rates ``start`` (2, voters)."""
        model = cls(prior, start, np.ones(bits.shape[1]))
        for _ in range(rounds):
            post = model.posterior(bits)
            masses = [counts * (1 - post), counts * post]
            fires = np.array([(m @ bits + 10 * start[k]) / (m.sum() + 10) for k, m in enumerate(masses)])
            # Correlations that the class does not explain, averaged over the classes.
            excess = np.zeros((bits.shape[1], bits.shape[1]))
            for k, m in enumerate(masses):
                centred = bits - fires[k]
                scale = np.sqrt(np.maximum(fires[k] * (1 - fires[k]), 1e-4))
                excess += (centred.T * m) @ centred / max(m.sum(), 1) / np.outer(scale, scale) * (m.sum() / max(counts.sum(), 1))
            np.fill_diagonal(excess, 0)
            weights = 1 / (1 + np.clip(excess, 0, 1).sum(axis=1))
            model = cls(float(np.clip(masses[1].sum() / max(counts.sum(), 1), 1e-4, 0.9)), np.clip(fires, 1e-4, 1 - 1e-4), weights)
        return model

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        fired, quiet = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        z = np.log(self.prior / (1 - self.prior)) + (bits * fired + (1 - bits) * quiet) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vote_bits(values: np.ndarray) -> np.ndarray:
    return ((values[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.float64)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float
    n_terms: int

    def features(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        return features(batch, self.n_terms)

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.weights + self.bias, -30, 30)))


def features(batch, n_terms: int) -> np.ndarray:
    """Terms hit, votes and logarithms of counts."""
    hits = batch.column("hits").combine_chunks() if isinstance(batch, pa.Table) else batch.column("hits")
    n = len(hits)
    x = np.zeros((n, n_terms + len(VOTERS) + 2), dtype=np.float32)
    sizes = np.diff(hits.offsets.to_numpy())
    x[np.repeat(np.arange(n), sizes), hits.flatten().to_numpy()] = 1
    x[:, n_terms:-2] = vote_bits(batch.column("votes").to_numpy())
    n_hits, n_words = batch.column("n_hits").to_numpy(), batch.column("n_words").to_numpy()
    x[:, -2], x[:, -1] = np.log1p(n_hits), np.log1p(1000 * n_hits / np.maximum(n_words, 1))
    return x


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    n = max(len(x), 1)
    scale = 0.25 * float((x ** 2).sum(axis=1).mean() + 1 if len(x) else 1) + ridge / n
    w, b = np.zeros(x.shape[1]), float(np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5)))
    ahead_w, ahead_b = w, b
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -30, 30)))
        new_w = ahead_w - (x.T @ (p - target) / n + ridge / n * ahead_w) / scale
        new_b = ahead_b - float((p - target).sum()) / n / scale
        ahead_w, ahead_b = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
    return w, b


def scored(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); ``labels`` (doc_id,
    label: 0 or 1) holds what may be learned from.

    Null and empty texts get no votes and score as such.  At most ``sample_docs``
    labelled documents, taken by a hash of doc_id, are used for terms and weights;
    the label model is fitted on the votes of all documents.  Without labels there
    are no mined terms, and the lexicons and patterns alone decide.
    """
    known = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    known = scratch.keep(known, "labels")
    labelled = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "sample")
    mined = mined_terms(labelled).toArrow().sort_by("term")
    order = np.argsort(mined.column("term").to_numpy().view(np.uint64))
    terms, kinds = mined.column("term").to_numpy().view(np.uint64)[order], mined.column("kind").to_numpy()[order]

    voted = scratch.keep(votes(docs, terms, kinds), "votes")
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).toArrow()  # 2 ** voters rows at most
    sample = voted.join(F.broadcast(known), "doc_id").limit(2 * sample_docs).toArrow()
    truth, sample_bits = sample.column("label").to_numpy().astype(float), vote_bits(sample.column("votes").to_numpy())
    rates = [(sample_bits[truth == k].sum(axis=0) + (0.5, 1.0)[k]) / ((truth == k).sum() + (50, 5)[k]) for k in (0, 1)]
    prior = (truth.sum() + 1) / (len(truth) + 20)
    model = LabelModel.fit(vote_bits(patterns.column("votes").to_numpy()), patterns.column("n").to_numpy().astype(float),
                           np.clip(np.array(rates), 1e-4, 1 - 1e-4), prior)
    weights, bias = logistic(features(sample, len(terms)), model.posterior(sample_bits))
    classifier = Classifier(weights, bias, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(doc_id=batch.column("doc_id"), score=classifier.score(batch))

    return voted.mapInArrow(run, "doc_id long, score double")
