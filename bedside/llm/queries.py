"""One query per operator over its whole table, and DuckDB text where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bedside.llm import (
    bpe, chat, exact_dedup, language, mixing, packing, phrases, quality, sharding, simhash, token_files, topk, vector_codes,
)
from bedside.llm.common import WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def words(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@query("op1_quality_classifier")
def quality_classifier(spark, sf_dir):
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_bpe_encode_decode")
def bpe_encode_decode(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), path)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


@query("op3_exact_top_k", TOP_K_SQL)
def exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op4_chat_formatting")
def chat_formatting(spark, sf_dir):
    return chat.repair_and_render(table(spark, sf_dir, "conversations"))


DEDUP_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""


@query("op5_exact_dedup", DEDUP_SQL)
def exact_copies(spark, sf_dir):
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


@query("op6_token_files")
def token_id_files(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.round_trip(table(spark, sf_dir, "documents"), path, end_id=2)


@query("op7_language_id")
def language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op9_hilbert_sharding")
def hilbert_sharding(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_curriculum_mixing")
def curriculum_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("n"))
    mixed = mixing.mix_in_order(docs, F.col("n"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.get("positions", F.lit(0)).alias("first_position"), F.get("starts", F.lit(0)).alias("first_start"),
    )


@query("op11_sequence_packing")
def sequence_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), path, end_id=0, capacity=1024)
    return pieces.mapInArrow(_with_crc32, pieces.schema.simpleString()[7:-1].replace("ids:array<int>", "ids_crc32:bigint"))


def _with_crc32(batches):
    """Lists of ids become the checksum of their little-endian 32-bit numbers."""
    for batch in batches:
        lists = batch.column("ids")
        values, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(pc.list_value_length(lists).to_numpy())
        crcs = [zlib.crc32(values[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        place = batch.schema.get_field_index("ids")
        columns = batch.columns[:place] + [pa.array(crcs, pa.int64())] + batch.columns[place + 1 :]
        names = [n.replace("ids", "ids_crc32") if i == place else n for i, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
  )
), places AS (
  SELECT lang, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM words WINDOW o AS (PARTITION BY id ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, w AS phrase, 1 AS k, count(*) AS n FROM places GROUP BY ALL
  UNION ALL SELECT lang, w || ' ' || x, 2, count(*) FROM places WHERE x IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w || ' ' || x || ' ' || y, 3, count(*) FROM places WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w || ' ' || x || ' ' || y || ' ' || z, 4, count(*) FROM places WHERE z IS NOT NULL GROUP BY ALL
), total AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, phrase, n, string_split(phrase, ' ') AS p FROM f WHERE n >= 30 AND k > 1
), inside AS (
  SELECT lang, phrase, max(n) AS longer FROM (
    SELECT lang, n, array_to_string(p[i:i + m - 1], ' ') AS phrase
    FROM c, (VALUES (2), (3)) AS a(m), (VALUES (1), (2), (3)) AS b(i) WHERE m < len(p) AND i + m - 1 <= len(p)
  ) GROUP BY ALL
), parts AS (
  SELECT lang, phrase, n AS a, s.k, array_to_string(p[1:s.k], ' ') AS p1, array_to_string(p[s.k + 1:len(p)], ' ') AS p2
  FROM c, (VALUES (1), (2), (3)) AS s(k) WHERE s.k < len(p)
), cuts AS (
  SELECT parts.*, l.n AS l, r.n AS r, ((2000000::HUGEINT * a) // (l.n + r.n))::BIGINT AS score
  FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = p1 JOIN f r ON r.lang = parts.lang AND r.phrase = p2
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE coalesce(100 * longer < 80 * a, true)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t USING (lang) WHERE r.rank <= 2000
"""


@query("op12_phrase_collocations", PHRASES_SQL)
def phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, most=2000)


CODES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT rid, p, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] AS s FROM v, range(16) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, k, s AS c FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64) USING (rid)
), {rounds}
a AS (SELECT rid, p, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d)::BIGINT AS d FROM (
  SELECT rid, x.p, k, {distance} AS d FROM x JOIN b2 b ON b.p = x.p) GROUP BY ALL
), coded AS (
  SELECT rid, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY p, k)) FROM (SELECT p, k, array_to_string(list_transform(c, lambda y: y::BIGINT), ',') AS x FROM b2)) AS codebooks_sha256
FROM coded JOIN v USING (rid)
"""
_DISTANCE = "list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c)"
_ROUND = """a{n} AS MATERIALIZED (SELECT rid, p, arg_min(k, {{'d': d, 'k': k}}) AS k FROM (
  SELECT rid, x.p, k, {distance} AS d FROM x JOIN b{n} b ON b.p = x.p) GROUP BY ALL
), m{n} AS (
  SELECT p, k, list(c ORDER BY j) AS c FROM (
    SELECT p, k, j, floor(sum(y) / count(*)) AS c FROM (
      SELECT p, k, unnest(s) AS y, generate_subscripts(s, 1) AS j FROM x JOIN a{n} USING (rid, p)
    ) GROUP BY p, k, j
  ) GROUP BY p, k
), b{m} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (p, k)
), """
CODES_SQL = CODES_SQL.format(
    rounds="".join(_ROUND.format(n=n, m=n + 1, distance=_DISTANCE) for n in range(2)), distance=_DISTANCE
)


@query("op13_vector_codes", CODES_SQL)
def vector_code_compression(spark, sf_dir):
    coded, entries = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    found = vector_codes.with_label_errors(coded)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(entries)).alias("codebooks_sha256"))
