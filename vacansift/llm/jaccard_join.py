"""Similarity join of documents by word shingles, with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 0.8. If tokens are put in one order for all
documents, such sets share at least L tokens among their first ``n - ceil(0.8 n) + L``. The order is: rare first, by a count sketch over all
documents, so that shingles of common passages come last. For each document L is chosen by cost: a longer prefix is one more posting,
but asks for one more common token, which bounds the candidates by the sum of the tokens' counts over L. A pair is counted at the smaller L of both.

Copies (equal sets) are reduced to one representative first. Each node is compared with one head, the most shared document of the lists that it shares
most tokens of; nodes near their head, and heads near theirs, are a family. Families are looked through in blocks, so pairs inside one are never rows.
At last families that share enough prefix tokens are paired, one row per token and family, and those pairs that may still hold a link between different
components are compared in blocks as well, which makes the components exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansift.llm import word_hashes
from vacansift.llm.arrow_text import pieces, utf8
from vacansift.llm.components import components
from vacansift.llm.shared import saved, text_or_empty

SHINGLE = 5
#: Similarity as a ratio of whole numbers: links need inter * PARTS >= union * SHARE.
SHARE, PARTS = 80, 100
MOST_MATCHES = 24
#: Counters of the sketch, 2 ** SKETCH_BITS, in blocks. The sketch has the same size for any input.
SKETCH_BITS, _BLOCK = 21, 1 << 16
#: Bits of the filter that says whose sets to write; a full filter only means writing more sets.
FILTER_BITS = 24
#: Similarity, as SHARE, from which a node belongs to the family of its head. It changes the work, not the result.
FAMILY_SHARE = 50
#: Sets and tokens per block when the pairs of a family are looked through.
BLOCK, BLOCK_TOKENS = 256, 1 << 20
_PIECE_BYTES = 1 << 19  # of text at a time; arrays of words and shingles take some forty times as much


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    data, offsets = utf8(batch.column("text"))
    words, _, _, bounds = word_hashes.words(data, offsets, lower=True)
    shingles = word_hashes.runs(words, SHINGLE)
    for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield row, np.unique(shingles[a : b - SHINGLE + 1] if b - a >= SHINGLE else word_hashes.runs(words[a:b], max(b - a, 1)))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _class(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    """The class of equal sets as a number."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _new_classes(batch: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and set of each class that a task has not met yet, so that copies leave a task once at most."""
    if len(seen) > 1_000_000:
        seen.clear()
    for _, tokens in shingle_sets(batch):
        digest = _class(tokens)
        if len(tokens) and digest not in seen:
            seen.add(digest)
            yield _node(digest), tokens


def _needed(n: int) -> int:
    """Tokens that a set of size n shares with any linked one, at least."""
    return -(-SHARE * n // PARTS)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end rows with the task's sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["doc_id", "key", "n", "digest", "block", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    seen = False
    for whole in batches:
        for batch in pieces(whole, limit=_PIECE_BYTES):
            sizes, digests = [], []
            for _, tokens in shingle_sets(batch):
                sizes.append(len(tokens))
                digests.append(_class(tokens))
                np.add.at(counts, _slots(tokens), 1)
            seen = True
            empty = [pa.nulls(batch.num_rows, t) for t in types[4:]]
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(sizes, types[2]), pa.array(digests, types[3]), *empty]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    if seen:
        small = np.minimum(counts, 65535).astype(np.uint16)
        for block in range(len(small) // _BLOCK):
            row = [[None], [None], [None], [None], [block], [small[block * _BLOCK : (block + 1) * _BLOCK].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for frame in batches:
        for block, counts in zip(frame["block"], frame["counts"], strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.uint16).astype(np.uint32)
    yield pd.DataFrame({"block": list(sums), "counts": [v.tobytes() for v in sums.values()]}, columns=["block", "counts"])


def _sketch(profiles: DataFrame) -> np.ndarray:
    blocks = profiles.where("block IS NOT NULL").select("block", "counts").repartition("block")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in blocks.mapInPandas(_add_up, "block int, counts binary").collect():
        sketch[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return sketch


def prefix(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set in the common order, and its number of matches L.

    Token number k of the prefix belongs to the prefix for L = 1 if ``k <= n - needed``, and to that for L = k - (n - needed) + 1 otherwise.
    """
    n = len(tokens)
    needed = _needed(n)
    base = n - needed
    order = np.lexsort((tokens, np.log2(counts + 1.0).astype(np.int8)))[: base + min(MOST_MATCHES, needed)]
    scanned = np.cumsum(counts[order])
    matches = np.arange(1, len(order) - base + 1)
    cost = (base + matches) + scanned[base:] / matches * (n / 8)
    best = int(cost.argmin()) + 1
    return tokens[order[: base + best]], best


def _postings(sketch: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in pieces(whole, limit=_PIECE_BYTES):
                parts: list[tuple[np.ndarray, ...]] = []
                for node, tokens in _new_classes(batch, seen):
                    own, best = prefix(tokens, sketch[_slots(tokens)])
                    level = np.maximum(np.arange(len(own)) - (len(tokens) - _needed(len(tokens))) + 1, 1)
                    same = np.ones(len(own), np.int64)
                    parts.append((own.view(np.int64), same * node, same * len(tokens), same * best, level))
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int8()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                        names=["token", "node", "n", "matches", "level"],
                    )

    return run


def _sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """Shingle sets of at least the ``active`` nodes: node, tokens (binary). Texts are not shuffled for it."""
    bit = F.pmod("node", F.lit(1 << FILTER_BITS))
    words = (
        active.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(pmod(node, {1 << FILTER_BITS}) % 64))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words:
        bits[r["word"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in pieces(whole, limit=_PIECE_BYTES):
                wanted = [
                    (node, tokens.tobytes())
                    for node, tokens in _new_classes(batch, seen)
                    if int(bits[(at := node % (1 << FILTER_BITS)) >> 6]) >> (at & 63) & 1
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in wanted], pa.int64()), pa.array([t for _, t in wanted], pa.binary())],
                    names=["node", "tokens"],
                )

    return saved(docs.select("text").mapInArrow(run, "node long, tokens binary"), "sets")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar, near = [], []
        for a, b in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - shared
            similar.append(shared * PARTS >= union * SHARE)
            near.append(shared * PARTS >= union * FAMILY_SHARE)
        columns = [batch.column("a"), batch.column("b"), pa.array(similar, pa.bool_()), pa.array(near, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similar", "near"])


def _unique_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """One set of each of the ``nodes``; tasks may have written copies."""
    return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with whether their sets are similar, and near enough for one family; written."""
    heads = _unique_sets(sets, pairs.select(F.col("b").alias("node")).distinct())
    members = _unique_sets(sets, pairs.select(F.col("a").alias("node")))
    a = members.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    b = heads.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b")
    return saved(both.mapInArrow(_compared, "a long, b long, similar boolean, near boolean"), "links")


def _fits(n_a: Column, n_b: Column) -> Column:
    return (n_a * PARTS >= n_b * SHARE) & (n_b * PARTS >= n_a * SHARE)


def _star_pairs(postings: DataFrame) -> DataFrame:
    """For each node the head that it shares most tokens with: a, b. At most one pair per node.

    The head of a token's list is the node whose prefix is shared most, so heads of heads come to an end.
    """
    order = F.struct((-F.col("lead")).alias("draw"), "node", "n")
    heads = postings.groupBy("token").agg(F.min(order).alias("head"))
    met = (
        postings.join(heads, "token")
        .where((F.col("node") != F.col("head.node")) & _fits(F.col("n"), F.col("head.n")))
        .groupBy(F.col("node").alias("a"), F.col("head.node").alias("b"))
        .agg(F.count("*").alias("shared"))
    )
    return met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def _families(near: DataFrame) -> DataFrame:
    """node, family: where each node's chain of heads ends, for all nodes but these ends. ``near``: pairs (a, b) of a node and its head.

    Chains are halved each round, and every round is written.
    """
    hops = saved(near.select(F.col("a").alias("node"), F.col("b").alias("family")), "families")
    while True:
        further = hops.select(F.col("node").alias("family"), F.col("family").alias("end"))
        followed = hops.join(further, "family", "left")
        if followed.where("end IS NOT NULL").isEmpty():
            return hops
        hops = saved(followed.select("node", F.coalesce("end", "family").alias("family")), "families")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between different components among the sets of one or two blocks, one for each pair of components.

    All intersections at once: a matrix of sets and tokens, in slices of tokens, times itself.
    """
    sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
    sizes = np.array([len(s) for s in sets])
    component = table.column("component").to_numpy()
    row = np.repeat(np.arange(len(sets)), sizes)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(token.max()) + 1, 8192):
        inside = (token >= start) & (token < start + 8192)
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[inside], token[inside] - start] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None] - shared
    x, y = np.nonzero((shared * PARTS >= union * SHARE) & (component[:, None] < component[None]))
    _, first = np.unique(np.stack([component[x], component[y]]), axis=1, return_index=True)
    node = table.column("node").to_numpy()
    return pa.table({"a": node[x[first]], "b": node[y[first]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _blocks() -> Column:
    """Blocks for a group of sets, by their number and by their tokens."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("blocks")


def _compared_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the sets that meet in a task. ``rows``: family, i, j (the task), node, component."""
    rows = saved(rows, "blocks")
    met = rows.join(_unique_sets(sets, rows.select("node").distinct()), "node")
    return saved(met.groupBy("family", "i", "j").applyInArrow(_block_links, "a long, b long"), "links")


def _own(blocks: str = "blocks") -> Column:
    return F.expr(f"pmod(xxhash64(node, 7), {blocks})")


def _family_links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside families that are still in several components. ``nodes``: node, n, component, family.

    Pairs are never rows: a family is cut into blocks of about ``BLOCK`` sets or ``BLOCK_TOKENS`` tokens, and a task gets two blocks.
    """
    split = (
        nodes.groupBy("family")
        .agg(_blocks(), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("family", "blocks")
    )
    placed = nodes.join(split, "family").withColumn("own", _own())
    rows = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _compared_blocks(
        rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component"), sets
    )


def _family_pairs(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of families (a, b) that may hold linked nodes of different components.

    A link between them shares as many prefix tokens as the smaller of its two nodes' matches, at levels within it; so do the families, with the least
    matches and levels of their nodes. Nodes of one family are one row per token, so that a group of near copies doesn't pair with itself.
    """
    rows = postings.join(nodes.select("node", "component", "family"), "node")
    lists = saved(
        rows.groupBy("token", "family").agg(
            F.min("n").alias("n_low"),
            F.max("n").alias("n_high"),
            F.min("matches").alias("least"),
            F.max("matches").alias("most"),
            F.min("level").alias("level"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        ),
        "family-tokens",
    )
    mixed = lists.groupBy("token").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("families"))
    lists = lists.join(mixed.where("families > 1 AND first <> last").select("token"), "token", "left_semi")
    left, right = (lists.select("token", *[F.col(c).alias(f"{c}_{s}") for c in lists.columns[1:]]) for s in "ab")
    least = F.least("least_a", "least_b")
    return (
        left.join(right, "token")
        .where(
            (F.col("family_a") < F.col("family_b"))
            & ((F.col("low_a") != F.col("high_b")) | (F.col("high_a") != F.col("low_b")))
            & (F.col("n_high_a") * PARTS >= F.col("n_low_b") * SHARE)
            & (F.col("n_high_b") * PARTS >= F.col("n_low_a") * SHARE)
            & (F.col("level_a") <= F.col("most_b"))
            & (F.col("level_b") <= F.col("most_a"))
        )
        .groupBy(F.col("family_a").alias("a"), F.col("family_b").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(least).alias("least"))
        .where("shared >= least")
        .select("a", "b")
    )


def _partner_links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the families of the ``pairs``. The larger family of a pair meets all its smaller partners' nodes together, in blocks as above."""
    sizes = saved(nodes.groupBy("family").agg(F.count("*").alias("size"), _blocks()), "sizes")
    a = sizes.select(F.col("family").alias("a"), F.struct("size", F.col("family").alias("id")).alias("of_a"))
    b = sizes.select(F.col("family").alias("b"), F.struct("size", F.col("family").alias("id")).alias("of_b"))
    ranked = saved(
        pairs.join(a, "a").join(b, "b").select(F.greatest("of_a", "of_b")["id"].alias("owner"), F.least("of_a", "of_b")["id"].alias("family")),
        "family-pairs",
    )
    guests = ranked.join(nodes, "family").select("owner", "node", "n", "component")
    packs = guests.groupBy("owner").agg(_blocks().alias("packs"))
    owners = packs.join(sizes.select(F.col("family").alias("owner"), "blocks"), "owner")
    hosts = owners.join(nodes.withColumnRenamed("family", "owner"), "owner")
    every = "explode(sequence(0L, {} - 1))"
    host_rows = hosts.select(F.col("owner").alias("family"), _own().alias("i"), F.expr(every.format("packs")).alias("j"), "node", "component")
    guest_rows = guests.join(owners, "owner").select(
        F.col("owner").alias("family"), F.expr(every.format("blocks")).alias("i"), _own("packs").alias("j"), "node", "component"
    )
    return _compared_blocks(host_rows.unionByName(guest_rows), sets)


def _shared_only(postings: DataFrame) -> DataFrame:
    """Postings of tokens in more than one node, of nodes that can reach the matches some partner asks for."""
    token = Window.partitionBy("token")
    shared = saved(
        postings.withColumn("low", F.min("node").over(token))
        .withColumn("high", F.max("node").over(token))
        .withColumn("least", F.min("matches").over(token))
        .where("low <> high")
        .drop("low", "high")
        .dropDuplicates(["token", "node"]),
        "postings",
    )
    enough = [
        (F.col("matches") >= k) & (F.count(F.when(F.col("least") <= k, 1)).over(Window.partitionBy("node")) >= k)
        for k in range(1, MOST_MATCHES + 1)
    ]
    # How much of a node's prefix other nodes share: in a group of near copies the least changed text leads.
    prefix_size = F.col("n") - F.ceil(F.col("n") * SHARE / PARTS) + F.col("matches")
    lead = F.count("*").over(Window.partitionBy("node")) / prefix_size
    return saved(
        shared.withColumn("enough", reduce(or_, enough)).withColumn("lead", lead).where("enough").drop("enough", "least"), "postings"
    )


def _with_component(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")


def join(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    See ``members``.
    """
    return members(docs).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame) -> DataFrame:
    """What ``join`` returns, with key (hash of the text) and component (a number of the component, null without shingles).

    Words are runs of characters other than white space, A-Z lower-cased. A text of one to four words has one shingle, the whole sequence;
    null, empty and blank texts have none and link with nothing. Rows with equal sets link whatever their ids; a null id takes part in that
    and is passed over when the smallest is looked for. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(text_or_empty()).alias("key"))
    profiles = saved(rows.mapInArrow(_profile, "doc_id long, key long, n long, digest binary, block int, counts binary"), "profiles")
    sizes = profiles.where("block IS NULL").select("doc_id", "key", "n", "digest")
    postings = _shared_only(
        rows.select("text").mapInArrow(
            _postings(_sketch(profiles)), "token long, node long, n int, matches tinyint, level tinyint"
        )
    )
    sets = _sets(rows, postings.select("node").distinct())
    stars = _star_links(saved(_star_pairs(postings), "star-pairs"), sets)
    links = stars.where("similar").select("a", "b")
    families = _families(stars.where("near"))
    nodes = postings.select("node", "n").distinct().join(families, "node", "left")
    nodes = saved(nodes.withColumn("family", F.coalesce("family", "node")), "nodes")
    links = links.unionByName(_family_links(_with_component(nodes, components(links)), sets))
    labels = components(links)
    nodes = saved(_with_component(nodes, labels), "nodes")
    rest = _partner_links(_family_pairs(postings, nodes), nodes, sets)
    # What was joined up enters as one link from each node to its label.
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = components(stars.unionByName(rest))
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    classes = sizes.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("node", node)
    labelled_classes = classes.join(labels, "node", "left").select(
        "digest", "first", F.coalesce("label", "node").alias("label")
    )
    least = labelled_classes.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("reached"))
    reached = labelled_classes.join(least, F.col("label") == F.col("_label")).select(
        F.col("digest").alias("_digest"), F.col("label").alias("component"), "reached"
    )
    return sizes.join(reached, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "component", F.coalesce("reached", "doc_id").alias("component_id")
    )
