"""Registered queries on conversations: prefix trie and structure repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacansift.llm import prefix_trie, structure_repair
from vacansift.llm.registry import query
from vacansift.llm.shared import table


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    codes = f"[4294967295::BIGINT] || list_transform(range(1, length({text}) + 1), lambda i: ord(({text})[i])::BIGINT)"
    bits = "list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({codes}, lambda a, b: {bits}), 4294967295)"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _path(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A path (cost, edits, repaired lines) led on by one edit."""
    lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    return f"{{'k': {state}.k + {cost}, 's': {state}.s || '{letter}', 't': {lines}}}"


def _step(state: str, letters: dict[str, str], to: str) -> str:
    """The best way into a state over a row: deletion there, or a row kept or renamed from the states before it."""
    ways = [_path(state, "3", "D")]
    for before, initial in letters.items():
        kept = _path(before, f"CASE WHEN initial = '{initial}' AND NOT gone THEN cut ELSE 1000000 END", "K", "role || ':' || text")
        ways.append(kept)
        if to:
            ways.append(_path(before, "CASE WHEN gone THEN 1000000 ELSE 2 + cut END", "R", f"'{to}:' || text"))
    return _least(*ways)


def _insert(state: str, role: str) -> str:
    return _path(state, "2", "I", f"'{role}:'")


_FAR = "{'k': 1000000, 's': '', 't': []::VARCHAR[]}"
_VISIBLE = r"[^\x20\x09-\x0D]"

OP13_SQL = rf"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
),
coded AS (SELECT *, {_crc32_sql("name")} % 20 AS code FROM source),
damaged AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM coded
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
),
flagged AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair,
        NOT regexp_matches(text, '{_VISIBLE}') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
    FROM placed
),
rows AS (
    SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND open THEN 1 ELSE 0 END AS cut FROM flagged
),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
        sum((NOT blank AND again)::INT) AS duplicate, sum(cut) AS truncated,
        sum(coalesce(pair NOT IN ('su', 'ua', 'au'), false)::INT) AS illegal, max(pos) AS n
    FROM rows GROUP BY conv_id
),
paths AS (
    SELECT conv_id, 0::BIGINT AS pos, {{'k': 0, 's': '', 't': []::VARCHAR[]}} AS a, {_FAR} AS b,
        {{'k': 2, 's': 'I', 't': ['user:']}} AS c, {{'k': 4, 's': 'II', 't': ['user:', 'assistant:']}} AS d
    FROM counts
    UNION ALL
    SELECT conv_id, pos, a, b, {_least("c", _insert("a", "user"), _insert("b", "user"), _insert("d", "user"))} AS c,
        {_least("d", _insert(_least("c", _insert("a", "user"), _insert("b", "user"), _insert("d", "user")), "assistant"))} AS d
    FROM (
        SELECT rows.conv_id, rows.pos, {_path("a", "3", "D")} AS a, {_step("b", {"a": "s"}, "")} AS b,
            {_step("c", {"a": "u", "b": "u", "d": "u"}, "user")} AS c, {_step("d", {"c": "a"}, "assistant")} AS d
        FROM paths JOIN rows ON rows.conv_id IS NOT DISTINCT FROM paths.conv_id AND rows.pos = paths.pos + 1
    )
),
ends AS (
    SELECT counts.*, {_least("a", "d")} AS best FROM counts JOIN paths
    ON counts.conv_id IS NOT DISTINCT FROM paths.conv_id AND paths.pos = counts.n
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.k, 0) AS BIGINT) AS cost, coalesce(best.s, '') AS audit,
    sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with the damage that the repair is tried on, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes the full stops, exclamation and question marks, 3 repeats the row, 4 makes it a user's.
    """
    one = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")])
    code = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", one)
    return (
        turns.select("conv_id", "turn", F.coalesce("role", one).alias("role"), text.alias("text"), code.alias("code"))
        .where("code <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "")
            .when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


@query("op13_structure_repair", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return structure_repair.repair(damaged(turns), turns.select("conv_id"))


OP11_SQL = rf"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
),
rebuilt AS (
    SELECT c.conv_id, 0 AS own, k, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= h
    UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h
),
paths AS (
    SELECT conv_id, count(*) OVER along AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(sha256(length(role) || ':' || role || text), '') OVER along AS path
    FROM rebuilt WINDOW along AS (PARTITION BY conv_id ORDER BY own, k)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
),
ends AS (
    SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        CASE WHEN depth > 0 THEN left(path, 64 * (depth - 1)) END AS parent
    FROM paths GROUP BY path, depth
),
counted AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes
    LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) AS below ON below.parent = nodes.path
),
subtrees AS (
    SELECT left(path, 64 * top) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS top FROM counted) GROUP BY 1
)
SELECT counted.conv_id, counted.depth, above.conv_id AS parent_conv_id, counted.n_convs, counted.n_children, n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted JOIN subtrees USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes AS above ON above.path = counted.parent
"""

#: First turns of a conversation that others may start with, and conversations that share theirs.
HEAD, FAMILY = 3, 20


def _with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Conversations that start with the first turns of the first of twenty numbers, as many as the CRC-32 of their number modulo 4."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    family = Window.partitionBy("base")

    def head(column: str) -> Column:
        first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice(column, 1, HEAD)), ignorenulls=True).over(family)
        return F.coalesce(first, F.slice(column, 1, 0))

    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    rows = sequences.withColumn("base", base).select(
        "*", own.cast("int").alias("h"), head("key").alias("head_key"), head("words").alias("head_words")
    )

    def rebuilt(column: str) -> Column:
        rest = F.slice(column, F.col("h") + 1, F.size(column))
        return F.concat(F.slice(f"head_{column}", F.lit(1), F.col("h")), rest).alias(column)

    return rows.select("conv_id", rebuilt("key"), rebuilt("words"))


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(_with_shared_heads(prefix_trie.turn_arrays(table(spark, folder, "conversations"))))
