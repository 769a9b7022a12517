"""Decontamination, near copies and line dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import AWKWARD, rows_of

from squadlake.llm import keygroups, line_dedup, parity_join, winnowing
from squadlake.llm.components import components


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def windows(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = defaultdict(set)
    for item, text in items:
        words = word.findall(low(text))
        n = min(13, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            known[tuple(words[a:a + n])].add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = word.findall(low(text)), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(words) - n + 1):
                key = tuple(words[a:a + n])
                if key in known:
                    hit.update(range(a, a + n))
                    found |= known[key]
        out.append((doc_id, len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shortest", [13, 4, 1])
def test_contamination(spark, docs, scratch, shortest):
    rnd = random.Random(shortest)
    say = lambda n: " ".join(rnd.choice(["a", "b-c", "dé", "E", "9"]) for _ in range(n))
    items = [(i, say(rnd.choice([shortest, shortest + 1, 13, 14, 20]))) for i in range(10)] + [(50, None), (51, "--")]
    if shortest == 1:
        items.append((None, "b c"))
    rows = AWKWARD + [(i, say(rnd.choice([0, 1, 5, 13, 40, 120]))) for i in range(100, 180)]
    rows += [(200 + i, say(9) + " " + (text or "") + ", " + say(30)) for i, text in items[:6]]
    got = winnowing.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"), scratch)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == windows(rows, items)


def test_contamination_without_items(spark, docs, scratch):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in winnowing.contamination(docs(AWKWARD), none, scratch).collect())
    assert winnowing.contamination(docs(AWKWARD).where("false"), none, scratch).count() == 0


def near_classes(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def copies(rnd, words):
    words = list(words)
    for _ in range(rnd.choice([0, 1, 1, 2, max(1, len(words) // 45)])):
        i = rnd.randrange(len(words))
        words[i:i + rnd.choice([0, 1, 1])] = [f"x{rnd.random()}"] * rnd.choice([0, 1, 1])
        if not words:
            return ["z"]
    return words


def test_key_counts_add_up(docs, scratch, monkeypatch):
    rows = [(i, f"a b c d e own{i}") for i in range(300)] + [(900, "only once here you see"), (901, None)]
    whole = rows_of(parity_join.key_counts(docs(rows), 5, 80))
    monkeypatch.setattr(parity_join, "COMBINED_KEYS", 50)
    assert rows_of(parity_join.key_counts(docs(rows), 5, 80)) == whole
    times = [n for _, n in whole]
    assert 1 < min(times) and 100 < max(times) <= 300
    got = parity_join.combined(np.repeat(np.array([5, 7, 9], dtype=np.uint64), [1, 63, 200]))
    assert [(int(x) >> 6, int(x) & 63) for x in got] == [(5, 1), (7, 63), (9, 63), (9, 63), (9, 63), (9, 11)]


@pytest.mark.parametrize("case", ["blocks", "few frequent"])
def test_near_copies_beyond_the_bounds(docs, scratch, case, monkeypatch):
    monkeypatch.setattr(parity_join, *{"blocks": ("BLOCK_SETS", 4), "few frequent": ("MAX_FREQUENT", 3)}[case])
    rnd = random.Random(11)
    shared = [f"boiler{i}" for i in range(12)]
    rows = [(i, " ".join(shared + [f"w{rnd.randrange(3)}" for _ in range(rnd.choice([2, 4, 30]))])) for i in range(120)]
    assert rows_of(parity_join.classes(docs(rows), scratch)) == near_classes(rows)


def test_near_copies(docs, scratch):
    rnd = random.Random(5)
    rows, shared = list(AWKWARD), [f"boiler{i}" for i in range(30)]
    for _ in range(40):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 3, 4, 5, 6, 9, 12, 30, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 4, 9])):
            rows.append((100 + len(rows), " ".join(copies(rnd, base))))
    rows += [(1000 + i, " ".join(shared + [f"own{i}-{j}" for j in range(rnd.choice([1, 3, 20]))])) for i in range(30)]
    rnd.shuffle(rows)
    assert rows_of(parity_join.classes(docs(rows), scratch)) == near_classes(rows)


def test_no_documents_no_classes(docs, scratch):
    assert parity_join.classes(docs(AWKWARD).where("false"), scratch).count() == 0


def test_components_of_a_chain_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def deduplicated(rows, min_chars):
    first, out = {}, []
    place = lambda d: 2 ** 63 - 1 if d is None else d
    filled = lambda line: any(ord(c) > 32 for c in line)
    for d, text in rows:
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if filled(line):
                first[line] = min(first.get(line, (place(d), i)), (place(d), i))
    long = [x for x in first if len(x) >= min_chars]
    gone = {x for x in long if any(first[y] < first[x] and one_edit(x, y) for y in long)}
    for d, text in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        seen, kept = set(), []
        for line in text.split("\n"):
            if not filled(line) or not (line in seen or first[line][0] < place(d) or line in gone):
                kept.append(line)
            seen.add(line)
        out.append((d, "\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def test_lines(docs, scratch):
    rnd = random.Random(2)
    line = lambda: "".join(rnd.choice("abé 語x") for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 20, 25, 40])))
    base = [line() for _ in range(50)]

    def near():
        chars = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            i = rnd.randrange(len(chars) + 1)
            chars[i:i + rnd.choice([0, 1])] = rnd.choice(["", "a", "語"])
        return "".join(chars)

    rows = [r for r in AWKWARD if r[0] != 5] + [(i, "\n".join(rnd.choice([near, near, line])() for _ in range(rnd.choice([1, 2, 5, 15])))) for i in range(100, 200)]
    rows += [(105, rows[20][1]), (None, rows[30][1]), (300, "zz\nzz"), (301, "\n\n")]
    rnd.shuffle(rows)
    got = line_dedup.without_repeats(docs(rows), scratch, 10)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == deduplicated(rows, 10)
    assert set(got.columns) >= {"name", "key", "hash", "label"}
    assert line_dedup.without_repeats(docs(rows).where("false"), scratch).count() == 0


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_long_lines_by_words(docs, scratch, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 16)  # so that some are paired off and others compared by variants
    rnd = random.Random(most)
    word = lambda: rnd.choice(["ab", "é語", "ccccc", "d", "of", "the"]) + rnd.choice("xyz")

    def edited(line):
        line = line[:]
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(line) + 1)
            line[at:at + rnd.randrange(2)] = [word()] * rnd.randrange(2)
        return line

    lines = []
    for n, copies in ((4, 6), (5, 6), (9, 6), (10, 40), (11, 6), (15, 40), (16, 6), (24, 6)):
        base = [word() for _ in range(n)]
        lines += [base] + [edited(base) for _ in range(copies)]
    lines.append(lines[-1][:])
    rnd.shuffle(lines)
    texts = [rnd.choice([" ", "  "]).join(line) for line in lines]
    rows = [(i // 3, "\n".join(texts[i:i + 3])) for i in range(0, len(texts), 3)]
    first = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    bound = lambda a, b: min(min(len(a), len(b)) // 5, most)
    near = lambda x, y: one_edit(x, y) or 0 < bound(x.split(), y.split()) >= word_distance(x.split(), y.split())
    known = [x for x in first if len(x) >= 10]
    gone = {x for x in known if any(first[y] < first[x] and near(x, y) for y in known)}
    assert {x for x in gone if not any(first[y] < first[x] and one_edit(x, y) for y in known)}
    want = [(i // 3, "\n".join(x for j, x in enumerate(texts[i:i + 3], i) if first[x] == j and x not in gone)) for i in range(0, len(texts), 3)]
    got = line_dedup.without_repeats(docs(rows), scratch, 10, most, 5)
    assert rows_of(got, "doc_id", "text") == sorted(want, key=str)


def test_line_with_one_other_word_goes(docs, scratch):
    line = [f"word{i}" for i in range(40)]
    rows = [(1, " ".join(line)), (2, " ".join(line[:20] + ["another"] + line[21:]) + "\nand a line of its own"), (3, " ".join(line[:9] + line[10:] + ["end"]))]
    got = line_dedup.without_repeats(docs(rows), scratch)
    assert rows_of(got, "doc_id", "text") == [(1, " ".join(line)), (2, "and a line of its own"), (3, "")]


def test_lines_with_a_common_passage_are_not_paired_off(docs, scratch, monkeypatch):
    rnd = random.Random(7)
    say = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    passage, rests = say(40), [say(12) for _ in range(60)]
    lines = [passage + rest for rest in rests]
    lines += [passage + rest[:3] + ["one"] + rest[4:9] + ["two"] + rest[10:] for rest in rests[30:50]]  # within two words of theirs
    lines += [passage + rest[:2] + ["one"] + rest[3:6] + ["two"] + rest[7:11] + ["three"] for rest in rests[:20]]  # not within
    tried, later_of = [], line_dedup.later_of

    def counted(pairs, *others):
        tried.append(pairs.distinct().count())
        return later_of(pairs, *others)

    monkeypatch.setattr(line_dedup, "later_of", counted)
    got = line_dedup.without_repeats(docs([(i, " ".join(line)) for i, line in enumerate(lines)]), scratch)
    assert {r.doc_id for r in got.where("n_dropped > 0").collect()} == set(range(60, 80))
    assert sum(tried) < 8 * len(lines)  # two leaders of each of some keys, and those that hold a rare span


@pytest.mark.parametrize("wanted", [1, 2, 3, 4])
def test_rarest_spans_are_the_best_that_do_not_overlap(wanted):
    rnd = random.Random(wanted)
    for n in [wanted, wanted + 1, 9]:
        keys = {size: np.arange(size * 100, size * 100 + max(n - size + 1, 0), dtype=np.uint64) for size in (1, 3)}
        spans = [(int(k), i, size) for size, ks in keys.items() for i, k in enumerate(ks)]
        known = {k: rnd.randrange(6) for k, _, _ in spans}

        def least(at, left):
            if not left:
                return 0
            return min((known[k] + least(i + size, left - 1) for k, i, size in spans if i >= at), default=99)

        chosen = sorted((i, i + size) for k, i, size in spans if k in (got := line_dedup.rarest_spans(n, keys, known, wanted)))
        assert len(chosen) == wanted and all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:]))
        assert sum(known[k] for k in got) == least(0, wanted)


def test_keys_shared_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([rnd.randrange(-2**63, 2**63), i % 40 << 50]), rnd.randrange(12)) for i in range(3000)]

    def run(batches):
        for batch in batches:
            held = keygroups.KeyBlocks()
            held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), 3)
            for columns in held.blocks():
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            assert not list(held.blocks())

    names = defaultdict(set)
    for key, name in rows:
        names[key].add(name)
    blocks = spark.createDataFrame(rows, "key long, name long").repartition(5).mapInArrow(run, keygroups.BLOCK_SCHEMA)
    assert rows_of(keygroups.shared_in_blocks(blocks)) == sorted(((k, x, 3, len(v)) for k, v in names.items() if len(v) > 1 for x in v), key=str)
    assert keygroups.shared_in_blocks(blocks.where("false")).count() == 0
