"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.llm import (chat, line_dedup, mixture_pack, mtree, parity_join, phrases, quality, sumsq_pack, token_files, toxicity,
                           warc, whitening, winnowing)
from squadlake.llm.shared import Scratch

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Tasks for work dealt out by hand: a few for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


@registered
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        folder = scratch.folder("ids")
        manifest = token_files.write_token_files(
            table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), 2, scratch)
        return scratch.result(token_files.read_token_files(spark, manifest, folder, slots(spark)))


@registered
def op8_sumsq_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        pieces = scratch.keep(sumsq_pack.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 0), "pieces")
        return scratch.result(sumsq_pack.pack(pieces, pieces.count()))


@registered
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch)
        return scratch.result(found.select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            winnowing.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")))


@registered
def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.result(parity_join.classes(table(spark, sf_dir, "documents"), scratch))


@registered
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"), scratch)
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Labels of the documents that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col(column).alias("label"))


def decided(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@registered
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        scores = toxicity.scored(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "toxic"), scratch)
        return scratch.result(decided(scores, 0.5))


@registered
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        stats = scratch.keep(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
        model = quality.fit(stats, training_labels(spark, sf_dir, "quality"))
        return scratch.result(decided(quality.scored(stats, model), 0.3))


@registered
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hostile)
    with Scratch(spark) as scratch:
        formatted = scratch.keep(chat.format_conversations(conversations), "formatted")
        turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
        return scratch.result(chat.parse_conversations(formatted).select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars")))


ORACLES["op4_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    - (length(text) - length(replace(text, '<s>', ''))) / 3 * 1 - (length(text) - length(replace(text, '</s>', ''))) / 4 * 2
    - (length(text) - length(replace(text, '<turn>', ''))) / 6 * 4 - (length(text) - length(replace(text, '[INST]', ''))) / 6 * 4
    - (length(text) - length(replace(text, '[/INST]', ''))) / 7 * 5 AS chars,
    CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 6 ELSE 8 + length(role) END AS marks
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@registered
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        records = warc.archive_pages(table(spark, sf_dir, "pages"), scratch, slots(spark))
        return scratch.result(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@registered
def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        rows = scratch.keep(mtree.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "vectors")
        return scratch.result(mtree.top_k(rows, rows.where("vec_id % 50 = 0"), 5, scratch))


ORACLES["op6_mtree"] = """
WITH rows AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@registered
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        rows = whitening.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
        found = whitening.by_component(whitening.whiten(rows, scratch), "vec_id")
        return scratch.result(found.withColumn("deviation", F.col("deviation").cast("long")))


@registered
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = phrases.collocations(table(spark, sf_dir, "documents"), scratch)
        return scratch.result(phrases.top_phrases(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


ORACLES["op12_phrases"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
words AS (SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces),
following AS (
  SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
runs AS (
  SELECT lang, w AS phrase, 1 AS k FROM following
  UNION ALL SELECT lang, w || ' ' || w2, 2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM following WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM following WHERE w4 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
often AS MATERIALIZED (SELECT lang, phrase, f FROM counts WHERE f >= 30),
halves AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, p.f AS l, q.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (p.f + q.f) AS BIGINT) AS score
  FROM halves AS c JOIN often AS p ON p.lang = c.lang AND p.phrase = c.head JOIN often AS q ON q.lang = c.lang AND q.phrase = c.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (
  SELECT lang, a AS f, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM candidates, (VALUES (2), (3)) AS sizes(size) WHERE size < k)),
largest AS (SELECT lang, phrase, max(f) AS f FROM spans GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, t.n, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best AS b JOIN totals AS t ON t.lang = b.lang
  LEFT JOIN largest AS x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE x.f IS NULL OR CAST(100 AS HUGEINT) * x.f < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@registered
def op13_mixture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.result(mixture_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 0, scratch))
