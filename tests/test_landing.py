"""Landing: hashes, idempotency, streaming restarts, tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from squadlake.sources import landed_index, seeds
from squadlake.sources.bronze import BronzeTable, explode_columnar, payload_hash, project_at_ingest, records_json
from squadlake.sources.roster import read_roster
from squadlake.sources.tables import TableStore, publish
from squadlake.streaming.landing import read_lines, stream_land


def payloads(rows, *docs):
    return rows("payload string, seq int", *[(json.dumps(d), i) for i, d in enumerate(docs)])


def test_hash_ignores_key_order_and_spaces_but_not_values(rows):
    got = [r[0] for r in rows("p string", ('{"a": 1.50, "b": {"y": null, "x": "é"}}',), ('{"b":{"x":"é","y":null},"a":1.5}',), ('{"b":{"x":"é"},"a":1.5}',))
           .select(payload_hash(F.col("p"))).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 32


def test_landing_is_idempotent(spark, rows, tmp_path):
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    assert table.read().count() == 0
    land = lambda df, batch, **kw: table.land(df, source="s", endpoint="/e", batch_id=batch, order=["seq"], **kw)
    first = land(payloads(rows, {"id": 1, "v": 1}, {"v": 1, "id": 1}, {"id": 2}), "b1", schema_version="v1")
    assert (first.fetched, first.inserted) == (3, 2)
    assert land(payloads(rows, {"id": 2}, {"id": 1, "v": 1}), "b2").inserted == 0
    third = land(payloads(rows, {"id": 1, "v": 2}, {"id": 2}, {"id": 3}), "b3")
    assert third.inserted == 2
    got = table.fetch("s", "/e")
    assert got.count() == 4 and got.select("id").distinct().count() == 4
    assert got.where("_batch_id = 'b1'").agg(F.max("id")).first()[0] < got.where("_batch_id = 'b3'").agg(F.min("id")).first()[0]
    # the same record under another source is another record
    assert table.land(payloads(rows, {"id": 2}), source="t", endpoint="/e", batch_id="b4", order=["seq"]).inserted == 1
    assert table.fetch("t").count() == 1


def test_ids_follow_emission_order(spark, rows, tmp_path):
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    table.land(payloads(rows, *[{"n": i, "pad": "x" * (i % 7)} for i in range(200)]).orderBy(F.rand(5)).repartition(6), source="s", endpoint="e", batch_id="b", order=["seq"])
    ids = [r.n for r in table.read().select("id", F.get_json_object("payload", "$.n").cast("int").alias("n")).orderBy("id").collect()]
    assert ids == list(range(200))


def write_lines(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(d) + "\n" for d in docs))


def test_stream_lands_each_file_once_and_survives_a_lost_checkpoint(spark, tmp_path):
    drop, table = tmp_path / "in", BronzeTable(spark, str(tmp_path / "bronze"))
    docs = [{"id": i, "v": i % 4} for i in range(40)]

    def land(checkpoint):
        return stream_land(read_lines(spark, str(drop), max_files=1), table, source="s", endpoint="/e", checkpoint=str(tmp_path / checkpoint))

    write_lines(drop, "a.json", docs[:15])
    write_lines(drop, "b.json", docs[10:25])
    land("c1")
    assert table.read().count() == 25
    land("c1")
    assert table.read().count() == 25
    write_lines(drop, "c.json", docs[20:])
    land("c1")
    assert table.read().count() == 40
    land("fresh")  # replay from the beginning
    assert table.read().count() == 40

    whole = BronzeTable(spark, str(tmp_path / "whole"))
    whole.land(spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string"), source="s", endpoint="/e", batch_id="one")
    same = lambda t: {r._payload_hash for r in t.read().select("_payload_hash").collect()}
    assert same(table) == same(whole)


@pytest.mark.parametrize("files", [1, 4])
def test_the_last_emission_of_a_key_gets_the_highest_id(spark, tmp_path, files):
    """Several versions of 40 keys, emitted in turn, over one or several micro-batches."""
    docs = [{"id": i, "v": v, "pad": "x" * ((i * 7 + v) % 11)} for v in range(3) for i in range(40)]
    size = len(docs) // files
    for n in range(files):
        write_lines(tmp_path / "in", f"{n}.json", docs[n * size:(n + 1) * size])
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    stream_land(read_lines(spark, str(tmp_path / "in"), max_files=1), table, source="s", endpoint="/e", checkpoint=str(tmp_path / "c"))
    ids = [(r.i, r.v) for r in table.read().select(F.get_json_object("payload", "$.id").cast("int").alias("i"),
                                                   F.get_json_object("payload", "$.v").cast("int").alias("v"), "id").orderBy("id").collect()]
    assert ids == [(d["id"], d["v"]) for d in docs]


def test_broken_lines_are_rejected_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    stream_land(read_lines(spark, str(tmp_path / "in")), table, source="s", endpoint="/e", checkpoint=str(tmp_path / "c"))
    assert table.read().count() == 2 and [r.payload for r in table.rejects().collect()] == ['{"id": ']


def test_two_writers_never_share_ids(spark, rows, tmp_path):
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    assert [table._claim() for _ in range(3)] == [0, 1, 2]
    landed = table.land(payloads(rows, {"id": 1}), source="s", endpoint="/e", batch_id="b", order=["seq"])
    assert (landed.inserted, landed.rejected) == (1, 0) and table.read().first().id >> 43 == 3


def test_columnar_payloads_and_projection(rows):
    df = rows("h struct<time: array<string>, t: array<double>, w: array<double>>, stadium string, extra string",
              ((["10:00", "11:00"], [1.0, None], [3.0, 4.0]), "G", "x"))
    out = explode_columnar(project_at_ingest(df, ["h", "stadium"]), "time", ["t", "w"], "h", ["stadium"])
    assert [tuple(r) for r in out.collect()] == [("G", "10:00", 1.0, 3.0), ("G", "11:00", None, 4.0)]


def test_records_keep_nulls_and_drop_nan(rows):
    got = [json.loads(r[0]) for r in records_json(rows("a double, b string", (float("nan"), None), (1.5, "x"))).collect()]
    assert got == [{"a": None, "b": None}, {"a": 1.5, "b": "x"}]


def test_tables_can_be_rebuilt_from_themselves(spark, rows, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert not store.has("t") and store.read("t", "n bigint").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.replace("t", rows("n bigint", (1,)))
    for _ in range(3):
        store.replace("t", store.read("t").select((F.col("n") + 1).alias("n")))
    assert store.read("t").first().n == 4 and store.versions("t") == [3, 4]
    # a version without the committer's marker is not read
    broken = tmp_path / "store" / "t" / "version=9"
    broken.mkdir()
    assert store.read("t").first().n == 4


def test_seeds_and_roster(spark, tmp_path):
    assert seeds.stadiums(spark).count() == 32
    (tmp_path / "s.csv").write_text("team,stadium,city,state,latitude,longitude,is_dome,surface\nNE,G,F,MA,42.5,-71.25,false,turf\n")
    assert tuple(seeds.read_seed(spark, str(tmp_path / "s.csv"), seeds.STADIUM_SCHEMA).first())[4:7] == (42.5, -71.25, False)
    frame = spark.createDataFrame([("g", 1, 2, "F L", "F", "L", "NE", "QB", 220.0, 75.0, "x")],
                                  "gsis_id string, nfl_id bigint, espn_id bigint, full_name string, first_name string, last_name string, team string, "
                                  "position string, weight_lbs double, height_in double, other string")
    frame.write.parquet(str(tmp_path / "players"))
    assert "other" not in read_roster(spark, str(tmp_path / "players")).columns


def test_publish_follows_the_layer_policy(spark, rows):
    assert publish(rows("n bigint", (1,)), "stg_demo", "staging") == "stg_demo"
    assert publish(rows("n bigint", (1,)), "fact_demo", "facts") == "gold.fact_demo"
    publish(rows("n bigint", (2,)), "fact_demo", "facts")
    assert spark.table("gold.fact_demo").first().n == 2 and spark.table("stg_demo").count() == 1
    spark.sql("DROP DATABASE gold CASCADE")


def hash_bytes(table, files):
    root = table.index.hashes
    return sum(os.path.getsize(os.path.join(d, f)) for n, b in files for d, _, names in os.walk(f"{root}/{n:07d}/bucket={b}") for f in names if f.endswith(".parquet"))


def test_a_batch_reads_files_of_hashes_it_shares_only(spark, tmp_path, monkeypatch):
    """What a batch reads of the landed hashes does not grow with the batches before it."""
    monkeypatch.setattr(landed_index, "FILE_HASHES", 64)  # several files a batch
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    read, seen = [], table.index.suspects

    def noted(*args):
        read.append(seen(*args))
        return read[-1]

    monkeypatch.setattr(table.index, "suspects", noted)
    docs = [[{"batch": n, "i": i} for i in range(300)] for n in range(6)]
    frame = lambda rows: spark.createDataFrame([(json.dumps(d),) for d in rows], "payload string")
    for n in range(5):  # batch 3 brings 20 records of batch 1 again
        extra = docs[1][:20] if n == 3 else []
        got = table.land(frame(docs[n] + extra), source="s", endpoint="/e", batch_id=str(n))
        assert (got.fetched, got.inserted) == (300 + len(extra), 300)
    assert read[0] == [] and {n for n, _ in read[3]} >= {1} and len({b for n, b in read[3] if n == 1}) > 3
    whole = hash_bytes(table, {(n, b) for n in range(4) for b in range(8)})
    assert all(hash_bytes(table, files) <= whole / 20 for i, files in enumerate(read) if i != 3) and hash_bytes(table, read[3]) < 1.2 * whole / 4
    assert table.land(frame(docs[2]), source="s", endpoint="/e", batch_id="again").inserted == 0
    assert table.land(frame(docs[2]), source="t", endpoint="/e", batch_id="other").inserted == 300


def test_a_batch_that_was_not_indexed_is_found_again(spark, rows, tmp_path, monkeypatch):
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    table._claim()  # a writer that died before it landed anything
    docs = [{"id": i} for i in range(30)]
    with monkeypatch.context() as m:
        m.setattr(table.index, "add", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.land(payloads(rows, *docs), source="s", endpoint="/e", batch_id="b", order=["seq"])
    assert table.fetch("s").count() == 30
    assert table.land(payloads(rows, *docs, {"id": 99}), source="s", endpoint="/e", batch_id="b", order=["seq"]).inserted == 1
    assert table.fetch("s").count() == 31
