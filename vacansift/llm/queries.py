"""All registered queries of this subpackage."""

from vacansift.llm import (  # noqa: F401
    queries_chat, queries_conversations, queries_exact, queries_models, queries_pairs, queries_pieces, queries_tokens,
)
from vacansift.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
