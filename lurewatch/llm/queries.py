"""Registered queries of the operators: each on its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import (chat_format, decontaminate, fill_middle, html_text, language_id, minhash, mixing,
                           sharding, simhash, token_files, topk, toxicity, vector_codes)
from lurewatch.llm.common import held_out, in_training, read, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _chat_digest(batches):
    """What a reader of the formatted text and its loss mask finds."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = chat_format.read_back(text)
            every = "".join(f"{role}\n{body}\n" for role, body in turns)
            loss = "".join(chat_format.unescape(text[s["begin"]:s["end"]]) for s in spans)
            rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        n, turns_hash, chars, loss_hash, size = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()),
             pa.array(chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(size, pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                   "formatted_chars"])


@query("op1_chat_format")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(turns.unionByName(extra))
    return made.mapInArrow(_chat_digest, "conv_id long, n_turns long, turns_sha256 string, "
                                         "loss_chars long, loss_sha256 string, formatted_chars long")


@query("op2_html_main_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


@query("op3_language_filters")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language_id.learn(docs.where(in_training()))
    return language_id.predict(docs, model).withColumn("held_out", held_out()).select(
        "doc_id", "held_out", "lang_pred", "score")


SQL_EXACT_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op4_exact_top_k", SQL_EXACT_TOP)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op5_toxic_neighbours")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    index = toxicity.learn(docs.where(in_training()), read(spark, folder, "labels").where(in_training()))
    return toxicity.score(docs, index).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


@query("op6_mix_sources")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"), ["doc_id"]).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
        F.col("mix_shards").alias("shards"))


@query("op7_benchmark_passages")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


SQL_NEAR_COPIES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, coalesce(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
         END, []) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.low AS component_id,
       s.doc_id = c.low AS kept
FROM s JOIN c ON c.id = s.doc_id
"""


@query("op8_minhash_near_duplicates", SQL_NEAR_COPIES)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(read(spark, folder, "documents"), words=4)


@query("op9_bounded_ring_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(read(spark, folder, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         F.col("shard").cast("int"), F.col("slot").cast("long"),
                         F.lit(None).cast("int").alias("grown_shard"), "home_shard")


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(read(spark, folder, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"))


_PART_DISTANCE = ("CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
                  " AS BIGINT)")


def _lloyd(k: int) -> str:
    """One round in SQL: the nearest entry of each part, then the floor of the mean per entry."""
    floor = "(sum({0}) - (sum({0}) % count(*) + count(*)) % count(*)) // count(*)"
    mean = ", ".join(f"CAST({floor.format(f'x[{j}]')} AS BIGINT)" for j in range(1, 5))
    return f"""
a{k} AS (SELECT r, p, x, arg_min(j, (d, j)) AS j FROM (
    SELECT r, p, x, j, {_PART_DISTANCE} AS d FROM x JOIN c{k} USING (p)) GROUP BY r, p, x),
m{k} AS (SELECT p, j, [{mean}] AS c FROM a{k} GROUP BY p, j),
c{k + 1} AS (SELECT p, j, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (p, j)),"""


SQL_VECTOR_CODES = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, e[p * 4 + 1:p * 4 + 4] AS x FROM v, range(16) t(p)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p, j, x AS c FROM x JOIN s USING (r)),{_lloyd(0)}{_lloyd(1)}
f AS (SELECT r, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT r, p, j, {_PART_DISTANCE} AS d FROM x JOIN c2 USING (p)) GROUP BY r, p),
o AS (
  SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM f JOIN v USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c2) AS codebooks_sha256
FROM o
"""


@query("op11_vector_codes", SQL_VECTOR_CODES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(read(spark, folder, "embeddings")).drop("label")


SQL_FILL_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS h1,
         CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS h2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(h1, h2)], '') AS p,
         array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
         array_to_string(u[greatest(h1, h2) + 1:], '') AS s
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_middle", SQL_FILL_MIDDLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    kept = stored(fill_middle.store(read(spark, folder, "documents")), "frames")
    return fill_middle.digest(fill_middle.transform(kept))


@query("op13_simhash_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    made = stored(simhash.compare(read(spark, folder, "documents")), "fingerprints")
    every = simhash.near_counts(made, F.pmod("doc_id", F.lit(100)) == 0)
    own = F.col("fingerprint")
    return every.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(own).alias("fingerprint"),
        simhash.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        simhash.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(own, F.col("next_fingerprint")).alias("near_next"), "near_found")
