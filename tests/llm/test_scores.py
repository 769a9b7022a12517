"""Toxicity and quality: held-out accuracy, and awkward input."""

import random

import numpy as np
import pytest
from conftest_llm import AWKWARD, held_out
from pyspark.sql import functions as F

from squadlake.llm import quality, toxicity
from squadlake.llm.queries import QUERIES
from squadlake.llm.textblocks import SpanHasher


def corpus(n=900):
    rnd = random.Random(4)
    say = lambda k: " ".join("".join(rnd.choice("aeiourstnl") for _ in range(rnd.randint(2, 8))) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        toxic, good = rnd.random() < 0.15, rnd.random() < 0.8
        words = say(rnd.randint(20, 120)).split()
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum", "qrzak" + rnd.choice("aeiou"), "qrzakil"]))
        text = " ".join(words) + "."
        rows.append((i, text if good else rnd.choice([text.upper() + "!!! " * 9, text[:9] * 40, text.replace(" ", "$$$ ")])))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("name, column, threshold", [("op1_toxicity", "toxic", 0.5), ("op2_quality", "quality", 0.3)])
def test_held_out_rows_are_judged_well(spark, tables, name, column, threshold):
    rows, labels = corpus()
    folder = tables(documents=spark.createDataFrame(rows + [(None, "x"), (10_001, None), (10_002, "")], "doc_id long, text string"),
                    labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got.values())
    assert all(r.held_out == (d is not None and held_out(d)) for d, r in got.items())
    truth = {d: t if column == "toxic" else q for d, q, t in labels if held_out(d)}
    right = np.mean([got[d].predicted == want for d, want in truth.items()])
    assert right >= 0.95, right
    if column == "toxic":
        assert got[10_001].predicted == got[10_002].predicted == 0


def test_scores_do_not_depend_on_other_columns_or_held_out_labels(spark, tables):
    rows, labels = corpus(300)
    labels = [(d, 1 - q, 1 - t) if held_out(d) else (d, q, t) for d, q, t in labels]
    frame = lambda ls: spark.createDataFrame(ls, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = tables(documents=docs, labels=frame(corpus(300)[1]))
    before = {r.doc_id: r.score for r in QUERIES["op2_quality"](spark, folder).collect()}
    tables(documents=docs.withColumn("source", F.lit("s")), labels=frame(labels))
    assert {r.doc_id: pytest.approx(r.score) for r in QUERIES["op2_quality"](spark, folder).collect()} == before


def test_without_labels_and_without_documents(spark, docs, scratch):
    none = spark.createDataFrame([], "doc_id long, label int")
    stats = scratch.keep(quality.document_statistics(docs(AWKWARD)))
    scores = [r.score for r in quality.scored(stats, quality.fit(stats, none)).collect()]
    assert scores == [pytest.approx(scores[0])] * len(AWKWARD)
    assert toxicity.scored(docs(AWKWARD), none, scratch).count() == len(AWKWARD)
    assert toxicity.scored(docs(AWKWARD).where("false"), none, scratch).count() == 0
    assert quality.kept(docs(AWKWARD), quality.fit(stats, none), 0.0).count() == len(AWKWARD)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Ä bc, bc bc!", "", "AB\n12 $", "x"]
    one = [quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), SpanHasher())[0] for t in texts]
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    together = quality.statistics(np.frombuffer("".join(texts).encode(), np.uint8), ends, SpanHasher())
    assert np.allclose(together, np.array(one))


def test_dependent_voters_share_their_weight():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false)
    a, b = vote(0.8, 0.05), vote(0.7, 0.05)
    bits = np.stack([a, b, a, a], axis=1).astype(float)
    start = np.array([[0.1] * 4, [0.6] * 4])
    model = toxicity.LabelModel.fit(bits, np.ones(4000), start, 0.3)
    assert model.weights[1] > model.weights[0] and abs(model.prior - 0.3) < 0.1
    assert ((model.posterior(bits) > 0.5) == y).mean() > 0.85
