"""Registered queries whose results SQL expresses: decontamination, exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.llm import decontaminate, exact_dedup, line_dedup
from vacansift.llm.registry import query
from vacansift.llm.shared import table

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
hits AS (
    SELECT DISTINCT doc_id, item_id, i, size FROM (
        SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS span
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
    ) JOIN bw USING (size, span)
),
covered AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id
),
met AS (
    SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(met.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5_SQL = rf"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i,
        len(string_split(coalesce(text, ''), chr(10))) AS n
    FROM documents
),
placed AS (
    SELECT doc_id, i, trim(line, {_SPACE}) AS content, line || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END AS part,
        greatest(count(*) FILTER (trim(line, {_SPACE}) <> '') OVER (PARTITION BY doc_id ORDER BY i), 1) AS pos
    FROM raw
),
seq AS (
    SELECT doc_id, pos, content, lead(content) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM placed WHERE content <> ''
),
copies AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY content, next ORDER BY doc_id, pos) AS k FROM seq WHERE next IS NOT NULL
    ) WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM copies, (VALUES (0), (1)) AS s(step))
SELECT placed.doc_id, count(*) FILTER (content <> '') AS n_lines, count(*) FILTER (content <> '' AND gone.pos IS NOT NULL) AS n_removed,
    sha256(coalesce(string_agg(part, '' ORDER BY i) FILTER (gone.pos IS NULL), '')) AS kept_sha256
FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.pos = gone.pos
GROUP BY placed.doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # OP5_SQL counts lines only; the pipeline also takes long runs of fewer lines.
    return line_dedup.dedup(docs, run_words=None).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
