"""The prefix trie against one built node by node, and the interval search against a scan."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacansift.llm import prefix_trie, queries_conversations


def plainly(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}, with sets of members."""
    members = {}
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    rows = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(path))))
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in below]
        rows.append(
            (
                min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children.get(path, [])),
                sum(p not in children for p in below), sum((len(members[p]) - 1) * w for p, w in zip(below, words)),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


def ordered(rows):
    return [(r or "", x or "") for _, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] or ""))]


def conversations(seed, count, turns=6, kinds=2):
    rng = random.Random(seed)
    out = {}
    for conv in range(count):
        out[conv * 3] = [
            (k, rng.choice(["user", "assistant"][:kinds]), rng.choice(["a b c", "d\te", "", "one word more here"][: kinds + 1]))
            for k in range(rng.randrange(1, turns + 1))
        ]
    for copy in range(60):  # a large group of copies
        out[1000 + copy] = out[0]
    return out


def table(spark, convs):
    rows = [(c, t, r, x, "p") for c, turns in convs.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_trie_equals_plain_one(spark, batch):
    convs = conversations(3, 150)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch)
    try:
        found = prefix_trie.trie(prefix_trie.turn_arrays(table(spark, convs))).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(map(tuple, found), key=repr) == plainly({c: ordered(t) for c, t in convs.items()})


def test_extents_equal_a_scan():
    rng = np.random.default_rng(5)
    for count in (1, 2, 3, 17, 200):
        lcp = rng.integers(0, 5, count)
        lcp[0] = 0
        rows, depths = rng.integers(0, count, 300), rng.integers(1, 6, 300)
        left, right = prefix_trie.extents(prefix_trie.sparse_table(lcp), rows, depths)
        for row, depth, a, b in zip(rows, depths, left, right, strict=True):
            while row > 0 and lcp[row] >= depth:
                row -= 1
            assert a == row
            while row + 1 < count and (lcp[row + 1] >= depth):
                row += 1
            assert b == max(row, a)


def test_rebuilt_query_on_awkward_rows(spark, tmp_path):
    import zlib

    rng = random.Random(6)
    rows = []
    for conv in [-45, -20, -7, 0, *range(3, 19), 20, 41, 42, 59, 61, 62, 63, 64, 65]:
        for _ in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", None]), rng.choice(["a b", None, "", "ü\n x"])))
    rows += [(None, 1, "user", "of no conversation")]
    rows = [(c, t, r, x) for c, t, r, x in {(c, t): (c, t, r, x) for c, t, r, x in rows}.values()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r, x))
    own = {c: ordered(t) for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert [] in rebuilt.values()
    found = queries_conversations.op11(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == plainly(rebuilt)


def test_empty_table_and_only_blank_conversations(spark):
    turns = table(spark, conversations(1, 3))
    assert prefix_trie.trie(prefix_trie.turn_arrays(turns.limit(0))).collect() == []
    blank = prefix_trie.turn_arrays(turns).select("conv_id", F.slice("key", 1, 0).alias("key"), F.slice("words", 1, 0).alias("words"))
    (root,) = prefix_trie.trie(blank).collect()
    assert root["n_convs"] == 63 and root["n_leaves"] == 1 and root["n_children"] == 0 and root["saved_tokens"] == 0
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, [0, 3, 6, *range(1000, 1060)])).encode()).hexdigest()
