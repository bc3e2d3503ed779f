"""Families of near copies in the similarity join: several blocks, several families, brute force."""

import random

import pyarrow as pa
import pytest

from vacansift.llm import jaccard_join


def _components(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for doc, text in texts.items():
        words = text.split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    least = {doc: doc for doc in texts}

    def root(doc: int) -> int:
        while least[doc] != doc:
            doc = least[doc]
        return doc

    for a in texts:
        for b in texts:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {doc: root(doc) for doc in texts}


def _texts(changes: tuple[int, ...], copies: int, bases: int) -> dict[int, str]:
    """Copies of a few base texts that share a half, with so many words changed that some pairs link and most don't."""
    draw = random.Random(sum(changes) + copies)
    half = [f"w{draw.randrange(5000)}" for _ in range(60)]
    texts = {}
    for base in range(bases):
        words = half + [f"b{base}x{k}" for k in range(60)]
        for _ in range(copies):
            own = list(words)
            for at in draw.sample(range(len(own)), draw.choice(changes)):
                own[at] = f"c{draw.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize(("block", "tokens"), [(256, 1 << 20), (8, 1 << 20), (256, 1500)])
def test_families_of_several_blocks(spark, monkeypatch, block, tokens):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
    texts = _texts((1, 2, 3, 4, 6), 40, 4)
    rows = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == _components(texts)
    assert len({r["component_id"] for r in rows}) > 4


def test_partners_of_families(spark, monkeypatch):
    """Families that are found to be partners meet in blocks, whichever is the larger one."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    texts = _texts((0, 2, 4), 9, 1)
    own = {jaccard_join._node(jaccard_join._class(_set(t))): _set(t) for t in texts.values()}
    family = {node: 1 if k < 6 else 2 for k, node in enumerate(own)}
    nodes = spark.createDataFrame([(x, len(s), x, family[x]) for x, s in own.items()], "node long, n int, component long, family long")
    sets = spark.createDataFrame([(x, bytearray(s.tobytes())) for x, s in own.items()], "node long, tokens binary")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    found = {tuple(sorted(r)) for r in jaccard_join._partner_links(pairs, nodes, sets).collect()}
    across = {(x, y) for x in own for y in own if x < y and family[x] != family[y] and _similar(own[x], own[y])}
    assert across and across <= found


def _set(text: str):
    ((_, tokens),) = jaccard_join.shingle_sets(pa.record_batch({"text": [text]}))
    return tokens


def _similar(x, y) -> bool:
    shared = len(set(x.tolist()) & set(y.tolist()))
    return shared * 100 >= 80 * (len(x) + len(y) - shared)


def test_chains_of_heads_end_in_one_family(spark):
    near = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(30, 5), (40, 41)], "a long, b long")
    found = {r["node"]: r["family"] for r in jaccard_join._families(near).collect()}
    assert found == {**{k: 12 for k in range(1, 12)}, 30: 12, 40: 41}
