"""Whitening against numpy on plain lists."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from squadlake.llm import whitening
from squadlake.llm.queries import QUERIES

NAN, INF = math.nan, math.inf


def vectors(n=300, d=6, seed=5):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    rows += [(1000 + i, made[3].tolist()) for i in range(200)] + [(7, made[3].tolist()), (None, made[4].tolist())]  # a hot vector, repeated ids, none
    return rows + [(2000, None), (2001, [1.0, None] + [0.0] * (d - 2)), (2002, [NAN] * d), (2003, [INF] + [0.0] * (d - 1)), (2004, [])]


def brute(rows, components=16, by_copies=False):
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    copies = Counter(x for _, x in kept)
    fit = [x for x, m in copies.items() for _ in range(m if by_copies else 1)]
    n, totals = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, totals)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in kept:
        white = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, totals)]) @ axes[:, order] / np.sqrt(values[order])
        out[i, x] = (n, sum((n * c - s) ** 2 for c, s in zip(x, totals)), white, values[order] / values.sum())
    return kept, out


@pytest.mark.parametrize(("components", "by_copies"), [(16, False), (3, False), (16, True)])
def test_whitening_like_numpy(spark, scratch, components, by_copies):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4).selectExpr("*", "1 as n", "2 as copies", "3 as weight", "'y' as x", "5 as _d")
    got = whitening.whiten(whitening.quantised(df, "v").drop("_d"), scratch, components, by_copies).where("size(x) > 0").collect()
    kept, want = brute(rows, components, by_copies)
    assert sorted(map(str, [(r.vec_id, tuple(r.x)) for r in got])) == sorted(map(str, kept))
    signs = None
    for r in got:
        n, deviation, white, explained = want[r.vec_id, tuple(r.x)]
        assert (r.n, int(r.deviation)) == (n, deviation) and np.allclose(r.explained, explained, rtol=1e-9)
        signs = np.sign(np.array(r.whitened) * white) if signs is None else signs
        assert np.allclose(np.array(r.whitened) * signs, white, atol=1e-9) and r.identity_error < 1e-10


def test_degenerate_vectors(spark, scratch):
    schema = "vec_id long, v array<float>"
    for rows, sizes in (([], []), ([(1, None)], []), ([(1, []), (2, [])], [0, 0]), ([(1, [0.5, 1.0])] * 3, [0] * 3), ([(1, [0.0, 1.0]), (2, [0.0, 2.0])], [1, 1]),
                        ([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 2.5]), (5, [4.0, 1.0])], [1, 1, 2, 2, 2])):
        got = whitening.whiten(whitening.quantised(spark.createDataFrame(rows, schema), "v"), scratch).collect()
        assert sorted(len(r.whitened) for r in got) == sizes and all(r.identity_error is None or r.identity_error < 1e-9 for r in got)
    huge = whitening.whiten(whitening.quantised(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], schema), "v"), scratch).collect()
    assert {int(r.deviation) for r in huge} == {(2 ** 53) ** 2}


def test_op11_rows(spark, tables):
    rows = [(i, v) for i, v in vectors(400, 20) if v]
    got = QUERIES["op11_whitening"](spark, tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept, want = brute(rows)
    found = got.collect()
    assert len(found) == 16 * len(kept) and {r.component for r in found} == set(range(1, 17)) and len({r.identity_error for r in found}) == 1
    one = {r.component: r for r in found if r.vec_id == 9}
    n, deviation, white, explained = next(v for (i, _), v in want.items() if i == 9)
    assert one[1].n == n and one[1].deviation == deviation
    assert np.allclose([abs(one[c].whitened) for c in range(1, 17)], np.abs(white)) and np.allclose([one[c].explained for c in range(1, 17)], explained)
