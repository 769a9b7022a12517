"""Token files and packing against plain encodes."""

import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import AWKWARD, rows_of
from tokenizers import Tokenizer

from squadlake.llm import mixture_pack, pfor, sumsq_pack, token_files
from squadlake.llm.queries import QUERIES
from squadlake.llm.textblocks import text_chunks
from squadlake.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text, end: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_pieces_give_the_ids_of_the_whole_text(encode):
    rnd = random.Random(1)
    alphabet = " \n\t'sabé,.!1　\x85\x1c  ßst中😀"
    texts = ["a<|endoftext|>", "<|endoftext|><|endoftext|>", "x <|endoftext|> \n y", "half <|endof", "text|> other", "<<|endoftext|>>", "", None, "a  b", "it's don't 'tis", "<|endoftext|>a <|endoftext|>", "  lead", "trail  ", "日本語　 a"]
    texts += ["<|endoftext|>".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))) for _ in range(3)) for _ in range(200)]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    encoder, got = PieceEncoder(PATH, 2), []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string()), 500):
        ids, bounds = encoder.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [encode(t, 2).tolist() for t in texts]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50257, rng.integers(0, 2 ** 32, n), np.full(n, 7), np.where(rng.random(n) < 0.02, 2 ** 32 - 1, 3)):
        ids = ids.astype(np.uint32)
        held = pfor.TokenFile.parse(b"".join(pfor.encode_file(np.array([3, 0]), np.array([True, False]), np.array([n, 0]), ids)))
        assert (held.ids() == ids).all() and held.valid.tolist() == [True, False] and held.lengths.tolist() == [n, 0]
        for a, b in ((0, 5), (100, 333), (n - 3, n), (n, n + 9)):
            assert (held.ids(max(a, 0), b) == ids[max(a, 0):b]).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(128, 5, dtype=np.uint32)
    ids[[3, 90]] = 2 ** 31
    payload, starts = pfor.encode_blocks(ids)
    assert starts.tolist() == [0, 2 + 2 * 2] and payload[1] == 2 << 8


def test_files_hold_whole_documents_in_order(spark, docs, scratch, encode):
    rows = AWKWARD + [(i, f"doc {i} " * (i % 9)) for i in range(100, 160)]
    folder = scratch.folder("ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    manifest = token_files.write_token_files(docs(rows), folder, PATH, 2, scratch, file_ids=5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.count() > 2
    got = rows_of(token_files.read_token_files(spark, manifest, folder, 3))
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encode(text, 2)
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=str)
    empty = token_files.write_token_files(docs(rows).where("false"), scratch.folder("none"), PATH, 2, scratch)
    assert token_files.read_token_files(spark, empty, folder, 3).count() == 0


def test_pieces_and_sequences(docs, scratch, encode):
    rows = AWKWARD + [(i, "word and word " * (i % 70)) for i in range(100, 400)]
    pieces = scratch.keep(sumsq_pack.token_pieces(docs(rows), PATH, 0, 128))
    packed = sumsq_pack.pack(pieces, pieces.count(), 128).collect()
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in rows:
        ids, own = encode(text, 0), sorted(by_doc[doc_id], key=lambda r: r.start)
        if doc_id != 4:
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
            assert all(r.length == 128 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
            assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert len(by_doc[4]) == 2
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 128
    assert sumsq_pack.pack(pieces.where("false"), 0, 128).count() == 0


def test_packing_wastes_little():
    rng = np.random.default_rng(3)
    lengths = -np.sort(-np.clip(rng.lognormal(6, 1, 30_000), 1, 2048).astype(int))
    bins, offsets = sumsq_pack.place(lengths, 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048
    assert bins.max() + 1 <= 1.003 * np.ceil(lengths.sum() / 2048)
    assert bins[0] == 0 and offsets[0] == 0


def test_rows_of_one_id_go_to_several_tasks(docs, scratch):
    pieces = scratch.keep(sumsq_pack.token_pieces(docs([(None, "same words")] * 400), PATH, 0, 128))
    packed = sumsq_pack.pack(pieces, 400, 128, 50).collect()
    assert len({r.sequence_id >> 40 for r in packed}) > 3 and len(packed) == 400


def power_of_two(n):
    return n & (n - 1) == 0


def served_by_turns(sizes, weights, window):
    """Deficit round-robin one window after another: what each queue has been given."""
    given, deficits, out, left = [0] * len(sizes), [Fraction(0)] * len(sizes), [], sum(sizes)
    while left:
        size = min(window, left)
        left -= size
        owed, exact = size, [Fraction(0)] * len(sizes)
        live = [s for s in range(len(sizes)) if given[s] + deficits[s] < sizes[s]]
        while owed:
            whole = sum(weights[s] for s in live)
            step = min([Fraction(owed, whole)] + [(sizes[s] - given[s] - deficits[s] - exact[s]) / weights[s] for s in live])
            for s in live:
                exact[s] += step * weights[s]
            owed -= step * whole
            live = [s for s in live if given[s] + deficits[s] + exact[s] < sizes[s]]
        deficits = [d + e for d, e in zip(deficits, exact)]
        carry = Fraction(0)
        for s, d in enumerate(deficits):  # whole tokens are served; what is left is the next window's
            before = carry.__floor__()
            carry += d + given[s]
            served = carry.__floor__() - before - given[s]
            given[s], deficits[s] = given[s] + served, d - served
        out.append(list(given))
    return out


@pytest.mark.parametrize(("sizes", "weights"), [([1000, 5000, 30001], None), ([1000, 5000, 30001], [5, 3, 2]), ([700, 0, 700], [1, 1, 3]), ([3], [1]), ([900, 10], None)])
def test_windows_hold_each_queue_in_proportion(sizes, weights):
    mix = mixture_pack.Mixture(sizes, weights or [max(s, 1) for s in sizes], 256)
    want = served_by_turns(sizes, weights or [max(s, 1) for s in sizes], 256)
    assert [[mix.served(s, w + 1) for s in range(len(sizes))] for w in range(len(want))] == want
    places = sorted(p for s, n in enumerate(sizes) for at in range(0, n, 77) for a, m in mix.spans(s, at, min(77, n - at)) for p in range(a, a + m))
    assert places == list(range(sum(sizes)))


@pytest.mark.parametrize("targets", [None, {"a": 3, "b": 1, "absent": 2}, {"tiny": 1, "a": 1_000_000}])
def test_mixture_packing(spark, scratch, encode, targets):
    rows = [(i, t, "a") for i, t in AWKWARD] + [(i, "word and word " * (i % 70), "b" if i % 3 else None) for i in range(100, 300)] + [(999, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).selectExpr("*", "1 as part", "2 as position", "3 as queue")
    packed = mixture_pack.pack(df, PATH, 0, scratch, 128, 4, targets).collect()
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, _ in rows:
        ids, own = encode(text, 0), sorted(by_doc[doc_id], key=lambda r: r.start)
        if doc_id != 4:
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
            assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert sum(r.length for r in by_doc[4]) == 2 * len(encode(rows[4][1], 0))
    total, source = sum(r.length for r in packed), {r[0]: r[2] for r in rows}
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and (size == 128 or power_of_two(size) and size < 128)
    assert sum(sum(r.length for r in own) == 128 for own in by_sequence.values()) >= total // 128
    share = sum(r.length for r in packed if source[r.doc_id] == "a") / total if not targets else None
    for w in range(total // 512):
        held = sum(r.length for r in packed if r.sequence_id // 4 == w and source[r.doc_id] == "a")
        assert share is None or abs(held - 512 * share) < 2
    assert mixture_pack.pack(df.where("false"), PATH, 0, scratch).count() == 0


def test_op13_covers_every_id_once(spark, tables, encode):
    rows = [(i, "some words here " * (i % 50), f"s{i % 3}") for i in range(90)] + [(90, None, None), (91, "long " * 9000, "s0")]
    got = QUERIES["op13_mixture_pack"](spark, tables(documents=spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    for doc_id, text, _ in rows:
        ids, own = encode(text, 0), sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n == 1024 or n < 1024 and power_of_two(n) for n in sizes.values())
