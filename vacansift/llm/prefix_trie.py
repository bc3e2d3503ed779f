"""The prefix trie of conversations, from sorted conversations and their longest common prefixes.

Conversations, as arrays of turn ids, are sorted (range-partitioned, equal ones by their number, so that no group of copies is one task). A batch of
sorted rows is a block. In a block numpy computes the LCP of each row with the one before it and a sparse table of range minima over them. Every prefix that a row has
beyond its LCP is a candidate, a node of the trie; each candidate binary-searches its extent to the left and to the right independently,
in steps of halved powers of two that the sparse table answers, all candidates at once and without a stack. Extents are member intervals:
members, subtree words and leaves are differences of running sums over the rows.

A node whose interval crosses a border between blocks has a part in each block; parts are few (a block has at most one of each node), and are added up by
node. What a border counts twice is the path that the rows at both sides share, so it is taken off along that path; a border between tasks
needs the last row of a task and the first one of the next, a row a task.

Turn and node ids are 128-bit hashes; different turns are taken to have different ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansift.llm.shared import saved

_ID = "array<struct<a:long,b:long>>"
#: Nodes with more than this share of all nodes as children are looked up by broadcast; there are at most as many as its inverse.
HEAVY_SHARE = 1 / 500
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, key (array of turn ids), words (array): one row per conversation, turns by number (null first), then role, then id of the text.

    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), text, role).alias("b"),
        word_count(text).alias("words"),
    )
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(
        "conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))).alias("key"), F.col("t.words").alias("words")
    )


def word_count(text: Column) -> Column:
    """Stretches without ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")


# ---- blocks ----


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level j has the least of the 2**j values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval of rows that share ``depths`` turns with ``rows``. Value i is the LCP of rows i - 1 and i."""
    count = len(levels[0])
    left, right = rows.copy(), rows.copy()
    for j in reversed(range(len(levels))):
        level, step = levels[j], 1 << j
        fits = right + step < count
        fits[fits] = level[right[fits] + 1] >= depths[fits]
        right[fits] += step
        fits = left - step >= 0
        fits[fits] = level[left[fits] - step + 1] >= depths[fits]
        left[fits] -= step
    return left, right


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each item, and its place within the row, for rows of so many items."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class _Block:
    """Sorted rows: ids of turns flat, two columns of 64 bits, and offsets of rows."""

    def __init__(self, offsets: np.ndarray, ids: np.ndarray, words: np.ndarray) -> None:
        self.offsets, self.ids = offsets, ids
        self.lengths = np.diff(offsets)
        self.words = words.astype(np.int64)
        self.nodes = self._node_ids()
        total = np.concatenate([[0], np.cumsum(self.words)])
        #: Words of a row before and with each of its turns, and of the whole row.
        self.until = total[1:] - np.repeat(total[offsets[:-1]], self.lengths)
        self.row_words = total[offsets[1:]] - total[offsets[:-1]]

    def _node_ids(self) -> np.ndarray:
        """An id of each turn's prefix: a chain of mixed hashes along the row, position by position for all rows."""
        out = np.empty_like(self.ids)
        rows = np.flatnonzero(self.lengths > 0)
        state = np.zeros((len(rows), 2), np.uint64)
        depth = 0
        while len(rows):
            at = self.offsets[rows] + depth
            with np.errstate(over="ignore"):
                crossed = state + self.ids[at] + np.array([1, 2], np.uint64)
                state = np.stack([_mixed(crossed[:, 0] ^ _mixed(crossed[:, 1])), _mixed(crossed[:, 1] + crossed[:, 0] * _MIX[0])], axis=1)
            out[at] = state
            depth += 1
            more = self.lengths[rows] > depth
            rows, state = rows[more], state[more]
        return out

    def lcp(self) -> np.ndarray:
        """Turns that each row shares with the one before it; 0 for the first."""
        shared = np.minimum(self.lengths[1:], self.lengths[:-1])
        rows, at = _ranges(shared)
        equal = (self.nodes[self.offsets[rows] + at] == self.nodes[self.offsets[rows + 1] + at]).all(axis=1)
        # Node ids stand for whole prefixes, so the turns shared are as many as equal node ids.
        return np.concatenate([[0], np.bincount(rows[equal], minlength=len(shared))]).astype(np.int64)[: len(self.lengths)]


_SUMS = ("n_convs", "member_words", "node_words", "leaves")
_PART = ("a", "b", "depth", "parent_a", "parent_b", "conv_id", *_SUMS, "ends")
_EDGE = ("task", "last", "key", "words")
_FOUND = ", ".join(f"{c} long" for c in _PART[:-1]) + f", ends string, task int, last boolean, key {_ID}, words array<int>"


def _parts(block: _Block, convs: np.ndarray) -> dict[str, list | np.ndarray]:
    """One row for each node of a block, the rows of which are taken to follow nothing."""
    lcp, lengths = block.lcp(), block.lengths
    levels = sparse_table(lcp)
    rows, beyond = _ranges(lengths - lcp)
    depths = lcp[rows] + beyond + 1
    left, right = extents(levels, rows, depths)
    at = block.offsets[rows] + depths - 1
    before = block.until[at] - block.words[at]
    members = right - left + 1
    running = np.concatenate([[0], np.cumsum(block.row_words)])
    # Words of the nodes that a row adds to those before it: all but the words of the LCP.
    last = block.offsets[:-1] + lcp - 1
    shared = np.where(lcp > 0, block.until[np.maximum(last, 0)] if len(block.until) else 0, 0)
    added = np.concatenate([[0], np.cumsum(block.row_words - shared)])
    # A row's whole prefix is a leaf if the row adds it and the last row of its interval, the longest one, ends there too.
    whole = depths == lengths[rows]
    is_leaf = np.zeros(len(lengths), np.int64)
    is_leaf[rows[whole]] = lengths[right[whole]] == depths[whole]
    leaf = np.concatenate([[0], np.cumsum(is_leaf)])
    least = sparse_table(convs)
    span = np.frexp(members.astype(np.float64))[1] - 1
    smallest = np.empty(len(rows), np.int64)
    for j in np.unique(span):
        pick = span == j
        smallest[pick] = np.minimum(least[j][left[pick]], least[j][right[pick] - (1 << j) + 1])
    # Members that end at a node are the first ones of its interval: equal rows, in the order of their numbers.
    same = np.concatenate([[False], (lengths[1:] == lengths[:-1]) & (lcp[1:] == lengths[1:])])
    group_end = np.append(np.flatnonzero(~same)[1:], len(lengths))
    end_of = np.repeat(group_end, np.diff(np.append(np.flatnonzero(~same), len(lengths))))
    ends: list[str | None] = [None] * len(rows)
    for k in np.flatnonzero(whole):
        ends[k] = ",".join(map(str, convs[left[k] : end_of[left[k]]].tolist()))
    node = block.nodes.view(np.int64)
    parent = np.where((depths > 1)[:, None], node[np.maximum(at - 1, 0)], 0) if len(rows) else np.zeros((0, 2), np.int64)
    return {
        "a": node[at, 0],
        "b": node[at, 1],
        "depth": depths,
        "parent_a": parent[:, 0],
        "parent_b": parent[:, 1],
        "n_convs": members,
        "conv_id": smallest,
        "member_words": running[right + 1] - running[left] - members * before,
        "node_words": block.row_words[left] - before + added[right + 1] - added[left + 1],
        "leaves": leaf[right + 1] - leaf[left],
        "ends": ends,
    }


def _border(before: _Block, after: _Block) -> dict[str, list | np.ndarray]:
    """What blocks that meet count twice, of the last row of ``before`` and the first of ``after``: the shared path, and its end if it is taken for a leaf."""
    k, n = len(before.lengths) - 1, min(before.lengths[-1], after.lengths[0])
    a = before.nodes[before.offsets[k] : before.offsets[k] + n]
    shared = int((a == after.nodes[:n]).all(axis=1).sum())
    words = after.words[:shared]
    zeros, node = np.zeros(shared, np.int64), after.nodes[:shared].view(np.int64)
    above = np.concatenate([np.zeros((1, 2), np.int64), node[:-1]])[:shared]
    return {
        "a": node[:, 0],
        "b": node[:, 1],
        "depth": np.arange(1, shared + 1),
        "parent_a": above[:, 0],
        "parent_b": above[:, 1],
        "n_convs": zeros,
        "conv_id": [None] * shared,
        "member_words": zeros,
        "node_words": -np.cumsum(words[::-1])[::-1],
        "leaves": np.full(shared, -1 if before.lengths[-1] == shared else 0),
        "ends": [None] * shared,
    }


def _batch(rows: dict[str, list | np.ndarray], edges: list[dict]) -> pa.RecordBatch:
    """Rows of parts and of edges in one table; columns of the other kind are null."""
    count = len(rows["depth"]) if rows else 0
    key = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    columns = []
    for name in _PART:
        part = pa.array(rows.get(name, []), pa.string() if name == "ends" else pa.int64())
        columns.append(pa.concat_arrays([part, pa.nulls(len(edges), part.type)]))
    for name, kind in zip(_EDGE, [pa.int32(), pa.bool_(), key, pa.list_(pa.int32())], strict=True):
        columns.append(pa.array([None] * count + [e[name] for e in edges], kind))
    return pa.RecordBatch.from_arrays(columns, names=[*_PART, *_EDGE])


def _block(keys: pa.ListArray, words: pa.ListArray) -> _Block:
    flat = keys.flatten()
    ids = np.stack([np.asarray(flat.field(c)).astype(np.int64) for c in (0, 1)], axis=1).view(np.uint64) if len(flat) else np.zeros((0, 2), np.uint64)
    offsets = np.asarray(keys.offsets).astype(np.int64)
    return _Block(offsets - offsets[0], np.ascontiguousarray(ids), np.asarray(words.flatten()).astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    previous = edge = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, words = batch.column("key"), batch.column("words")
        block = _block(key, words)
        edges = []
        if previous is None:
            edges.append({"task": task, "last": False, "key": key[0].as_py(), "words": words[0].as_py()})
        else:
            yield _batch(_border(previous, block), [])
        yield _batch(_parts(block, np.asarray(batch.column("conv_id"))), edges)
        tail = batch.num_rows - 1
        previous = _block(key.slice(tail), words.slice(tail))
        edge = {"task": task, "last": True, "key": key[tail].as_py(), "words": words[tail].as_py()}
    if edge is not None:
        yield _batch({}, [edge])


def _task_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            before, after = (_block(batch.column(f"{c}key").slice(k, 1), batch.column(f"{c}words").slice(k, 1)) for c in ("before_", ""))
            yield _batch(_border(before, after), [])


# ---- whole trie ----


_NODE = (*_PART[:-1], "ends_sha256")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from their parts in order; the ids of the members that end at a node pass through its digest and are not held."""
    schema = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NODE])
    current, node, digest, some = None, {}, hashlib.sha256(), False
    for batch in batches:
        out = []
        for part in batch.to_pylist():
            key = (part["depth"], part["a"], part["b"])
            if key != current:
                if current is not None:
                    out.append({**node, "ends_sha256": digest.hexdigest()})
                current, digest, some = key, hashlib.sha256(), False
                node = {c: part[c] for c in _NODE[:-1]}
            else:
                for c in _SUMS:
                    node[c] += part[c]
                node["conv_id"] = min((c for c in (node["conv_id"], part["conv_id"]) if c is not None), default=None)
            if part["ends"] is not None:
                digest.update(f"{',' if some else ''}{part['ends']}".encode())
                some = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([{**node, "ends_sha256": digest.hexdigest()}], schema)


def _nodes(sequences: DataFrame) -> DataFrame:
    """All nodes of depth 1 and more, without what they know of other nodes but their parent's id."""
    order = ["key", "conv_id"]
    rows = sequences.select("conv_id", "key", "words").repartitionByRange(*order).sortWithinPartitions(*order)
    found = saved(rows.mapInArrow(_blocks, _FOUND), "trie-parts")
    edges = found.where("task IS NOT NULL").select(*_EDGE)
    # Two rows a task, whatever the number of conversations.
    along = Window.orderBy("task", "last")
    pairs = edges.select(
        "last", "key", "words", F.lag("key").over(along).alias("before_key"), F.lag("words").over(along).alias("before_words")
    ).where("NOT last AND before_key IS NOT NULL")
    borders = pairs.mapInArrow(_task_borders, _FOUND)
    parts = found.where("task IS NULL").unionByName(borders).select(*_PART)
    # Equal rows are sorted by their ids, so parts in the order of their first id give all ids in order.
    return (
        parts.withColumn("first", F.split("ends", ",")[0].cast("long"))
        .repartition("a", "b")
        .sortWithinPartitions("depth", "a", "b", "first")
        .drop("first")
        .mapInArrow(_merged, ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    )


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv_id (unique), key and words, as :func:`turn_arrays` makes them; a conversation's turn ids (16 bytes a turn) are held
    together, its texts are not. A node is a sequence of first turns; the root has depth 0, no parent (null) and all conversations, those
    without turns included. An empty table gives no rows, not even a root. ``saved_tokens`` are the words that members share within the subtree: for
    each of its nodes the words of its last turn, for all members but one. ``ends_sha256`` is that of the ids of members that end there, in order,
    joined by commas.
    """
    parent = ["parent_a", "parent_b"]
    sequences = saved(sequences.select("conv_id", "key", "words"), "trie-rows")
    nodes = saved(_nodes(sequences), "trie-nodes").withColumn("saved", F.col("member_words") - F.col("node_words"))
    children = saved(nodes.groupBy(*parent).agg(F.count("*").alias("n_children")), "trie-children")
    root = _root(sequences, nodes)
    names = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    # Parents of many nodes, and the root, are few and are broadcast; all other parents are joined.
    many = children.where(F.col("n_children") > max(1, int(nodes.count() * HEAVY_SHARE)))
    heavy = names.join(F.broadcast(many.select(*parent)), parent)
    zero = F.lit(0).cast("long")
    heavy = heavy.unionByName(root.select(zero.alias("parent_a"), zero.alias("parent_b"), F.col("conv_id").alias("parent_conv_id")))
    heavy = saved(heavy, "trie-heavy").withColumnRenamed("parent_conv_id", "heavy_conv_id")
    own = children.select(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"), "n_children")
    counted = nodes.join(own, ["a", "b"], "left").join(F.broadcast(heavy), parent, "left")
    results = [
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    ]
    by_heavy = counted.where("heavy_conv_id IS NOT NULL").withColumnRenamed("heavy_conv_id", "parent_conv_id").select(*results)
    by_join = counted.where("heavy_conv_id IS NULL").join(names, parent).select(*results)
    return by_heavy.unionByName(by_join).unionByName(root)


def _root(sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """The root's row, none for an empty table; put together from aggregates by a union, without a join."""
    members = sequences.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = (
        sequences.where(F.size("key") == 0)
        .select(F.lit(0).alias("root"), "conv_id")
        .repartition("root")
        .sortWithinPartitions("conv_id")
        .mapInArrow(_ids_digest, "ends_sha256 string")
    )
    parts = members.unionByName(top, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns]).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    return one.select(
        "conv_id",
        zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _ids_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, some = hashlib.sha256(), False
    for batch in batches:
        for conv in batch.column("conv_id").to_pylist():
            digest.update(f"{',' if some else ''}{conv}".encode())
            some = True
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()] if some else [], pa.string())], names=["ends_sha256"])
