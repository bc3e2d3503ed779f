"""Registered query: chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacansift.llm import chat_format
from vacansift.llm.registry import query
from vacansift.llm.shared import table

_PROBE = r"\### Assistant: </turn> ok"


def _escaped_length(column: str, signs: str) -> str:
    return f"length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, '{s}', '')))" for s in signs)


OP2_SQL = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{_PROBE}'), (-7, 1, 'assistant', '{_PROBE}')
),
g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(4 + 2 + 8 + {_escaped_length("role", chr(92) + "#<:")} + {_escaped_length("text", chr(92) + "#<")}) AS formatted_chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


@query("op2_chat_format", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], turns.schema)
    return chat_format.digests(chat_format.format_turns(turns.unionByName(probe)))
