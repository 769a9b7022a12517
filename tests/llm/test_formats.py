"""Chat formatting, WARC archives, top-k search, the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
from conftest_llm import AWKWARD, rows_of
from oracle import connect, compare
from conftest import SF

import corpus_pipeline
from squadlake.llm import chat, mtree, warc
from squadlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_oracles(spark, name):
    got, want = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert got == want and got[1]


def test_chat_round_trip(spark):
    turns = [(1, 1, "user", "a\\0<s>\\"), (1, 2, "user", "</s><turn>[INST]\\z\\1"), (1, 3, "assistant", ""), (1, 4, "assistant", None),
             (1, 5, "assistant", "x\ny\\"), (1, 5, "assistant", "x\ny\\"), (1, 6, None, "r"), (2, 1, "as\nsis</s>tant\\n", "t"), (None, None, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as turns")
    got = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(frame)).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(t[2] or "", t[3] or "") for t in own]
        assert got[conv].loss_text == "".join(t[3] or "" for t in own if t[2] == "assistant")
    assert got[1].formatted.count("<s>") == 3 and got[1].formatted.count("<turn>") == 4
    assert chat.format_conversations(frame.where("false")).count() == 0


def archive_rows(pages, least):
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        again = i is not None and first[html or ""] < i and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archives(spark, scratch, least):
    pages = [(1, "u\r\n", "aé"), (2, None, "aé"), (3, "x", None), (4, "x", ""), (None, "x", "aé"), (2, "y", "aé"), (9, "z", "\r\n\r\n" * 50),
             (8, "z", "WARC/1.1\r\n"), (7, "z", "x" * 300_000), (6, "z", "x" * 300_000), (5, "é", "zz")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).selectExpr("*", "1 as n", "2 as refers_to", "3 as file")
    got = scratch.keep(warc.archive_pages(frame, scratch, 3, least))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == archive_rows([(a, c) for a, _, c in pages], least)
    assert {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()} == {c or "" for _, _, c in pages}
    assert warc.archive_pages(frame.where("false"), scratch, 3).count() == 0


def test_records_are_split_whatever_the_pieces():
    raw = b"".join(warc.record(i, None, b"p" * i, None) for i in range(5))
    for size in (1, 7, 4096):
        parts = list(warc.split_records(iter([raw[i:i + size] for i in range(0, len(raw), size)])))
        assert b"".join(p for _, p in parts) == raw and sum(first for first, _ in parts) == 5
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw[:-3]])))


def test_search(spark, scratch):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=6).round(1).tolist()) for i in range(600)]
    rows += [(3000 + i, rows[50][1]) for i in range(300)] + [(9000, None), (9050, [1.0] * 5 + [float("nan")]), (9100, [0.0] * 6), (9150, [1.0, 2.0]),
                                                             (9200, [None] * 6), (None, [1.0] * 6), (100, rows[100][1]), (9250, [1e5] * 6), (9300, [])]
    rows += [(200, [n * x for x in rows[200][1]]) for n in range(2, 12)] + [(250, rows[200][1])]  # an id's own rows come before all others
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as tree", "4 as own")
    held = {(r.vec_id, tuple(int(np.floor(256 * float(x))) for x in r.embedding)) for r in frame.collect()
            if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    want = []
    for q in {q for q, _ in held if q % 50 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for own, a in held if own == q for i, b in held if i != q and len(a) == len(b))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    vectors = scratch.keep(mtree.quantised(frame, "vec_id", "embedding", 256).where("octet_length(vector) > 0"))
    assert rows_of(mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, scratch)) == sorted(want, key=str)
    assert mtree.top_k(vectors.where("false"), vectors.where("false"), 5, scratch).count() == 0


def test_stored_bounds_avoid_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 1000
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    tree = mtree.Tree(list(mtree.build_tree(0, vectors, [np.array([i]) for i in range(4000)])))
    for q in vectors[:20]:
        scores = vectors @ q
        assert sorted(s for s, _ in tree.search(q, 5)) == sorted(scores)[-5:]
    assert tree.computed < 20 * 4000 / 2


def test_pipeline_keeps_its_contract(spark, tables):
    rnd = random.Random(1)
    say = lambda k: " ".join("".join(rnd.choice("aeiourstnl") for _ in range(rnd.randint(2, 8))) for _ in range(k))
    good = {i: "\n".join(say(rnd.randint(20, 60)) for _ in range(4)) for i in range(120)}
    exam = say(30)
    rows = list(good.items()) + [(500, good[3]), (501, good[4].replace(" ", "  ", 1) + " and more"), (502, say(20) + " " + exam + " " + say(20))]
    rows += [(600 + i, text.upper() + "!!! " * 30) for i, text in enumerate(say(40) for _ in range(40))]
    labels = [(i, int(i < 600), 0) for i, _ in rows]
    documents = spark.createDataFrame(rows + AWKWARD[3:4], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    folder = tables(documents=documents, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                    benchmark=spark.createDataFrame([(1, exam)], "item_id long, text string"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    out = corpus_pipeline.run(spark, folder)
    left = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert left >= set(good) and not left & {500, 502} and not any(d and d >= 600 for d in left)
    apart = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, documents, folder).select("doc_id").collect()}
    assert set(good) <= apart and not apart & {500, 501}  # before its lines are gone, 501 is a near copy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, folder).columns == documents.columns
        assert stage(spark, documents.where("false"), folder).count() == 0
