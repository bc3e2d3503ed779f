"""Memory of the Python side: arrays of a piece of text stay small beside the Arrow batch that it is cut from."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vacansift.llm import jaccard_join, quality
from vacansift.llm.arrow_text import utf8

MOST = 64 << 20


def _batch(rows: int = 4000, words: int = 350) -> pa.RecordBatch:
    """About 8 MB of text in one batch."""
    rng = np.random.default_rng(3)
    some = np.array([f"word{i}" for i in range(3000)])
    texts = [" ".join(some[rng.integers(0, len(some), words)]) for _ in range(rows)]
    ids = pa.array(range(rows), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string())], names=["doc_id", "key", "text"])


def _peak(run) -> int:
    tracemalloc.start()
    try:
        for _ in run():
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


class _Frame:
    """Stands in for a DataFrame: holds the function that tasks run."""

    columns = ["doc_id", "key", "text"]
    schema = property(lambda self: self)

    def select(self, *columns):
        return self

    def add(self, *column):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_quality_memory_and_scores():
    batch = _batch()
    run = quality.score(_Frame(), quality.Network.fresh())
    assert _peak(lambda: run(iter([batch]))) < MOST
    found = np.concatenate([b.column("score").to_numpy() for b in run(iter([batch]))])
    whole = quality.scores(quality.Network.fresh(), *utf8(batch.column("text")))
    np.testing.assert_allclose(found, whole, atol=1e-5)


@pytest.mark.parametrize("run", [jaccard_join._profile, jaccard_join._postings(np.ones(1 << jaccard_join.SKETCH_BITS, np.uint32))])
def test_similarity_join_memory(run):
    batch = _batch()
    assert _peak(lambda: run(iter([batch]))) < MOST
