"""Phrase collocations against counts of every run of words."""

import random
import re
from collections import Counter

import duckdb
import pytest

from squadlake.llm import phrases
from squadlake.llm.queries import ORACLES, QUERIES


def brute(rows, least, share=80, scale=2_000_000, longest=4):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        score, _, l, r = min((scale * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        longer = [f for (other, q), f in candidates.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * f >= share * a for f in longer):
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "Große", "große", "日本", "a b", "x\x1cy", "ÉCLAIR", "zum", "zum"]
    return [(rnd.choice(["en", "de", None, "und", ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rnd.randint(0, 30))))
            for _ in range(n)]


AWKWARD = [("en", None), (None, ""), ("en", " .,;\t\n"), ("en", "one"), ("fr", "mot " * 40_000), ("en", "w" * 100_000 + " end"), (None, "same line of text"), (None, "same line of text")]


@pytest.mark.parametrize(("least", "limits"), [(2, None), (5, None), (2, (50, 7, 3))])
def test_phrases_like_brute_force(spark, scratch, monkeypatch, least, limits):
    if limits:  # tasks pass their sums on early, and most prefixes count as hot
        for name, value in zip(("TASK_ENTRIES", "HOT_SHARE", "SLICES"), limits):
            monkeypatch.setattr(phrases, name, value)
        monkeypatch.setattr(phrases, "HOT_SHARE", 1 << 20)
    rows = texts(least, 400) + AWKWARD
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr("*", "1 as n", "2 as phrase", "3 as prefix", "4 as count")
    got = phrases.collocations(df, scratch, least)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least)
    top = phrases.top_phrases(got, 3).collect()
    for lang in {r.lang for r in top}:
        best = sorted((r for r in brute(rows, least) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        assert [(r.phrase, r["rank"]) for r in sorted(top, key=lambda r: r["rank"]) if r.lang == lang] == [(b[1], i + 1) for i, b in enumerate(best)]


def test_no_words(spark, scratch):
    for rows in ([], [("en", None), (None, " . ")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), scratch).count() == 0


def test_op12_like_its_sql(spark, tables, tmp_path):
    rows = texts(7, 1500) + AWKWARD
    folder = tables(documents=spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"))
    got = QUERIES["op12_phrases"](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_phrases']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
