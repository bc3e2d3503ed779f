"""Repeated passages, found with a compressed FM-index per shard.

A window of ``WINDOW`` words belongs to its smallest 16-gram hash (its minimizer). Consecutive windows with the same one are a segment. Equal
windows have equal minimizers, so all places where a window can occur again meet under one minimizer, and shards of minimizers can be searched
apart: the work grows with the text, not with its square.

1. Segments are listed as numbers only (minimizer, hash of the words, place). Minimizers of a single document drop out.
2. A segment whose words also form a segment of a smaller document is removed whole. What is left to search are the segments that are the
   first of their words and share their minimizer with other ones.
3. These, each once, are spread over shards of bounded size. Per shard an FM-index over the words (a wavelet matrix of packed bits) is built, and
   the windows of all segments pass through it by backward search; a search ends when only its own place is left. Windows that reach
   their full length are reported if the smallest document in their suffix interval is smaller than their own.

A minimizer with too many different segments for a shard, as at the border of a very common passage, has its windows compared by 128-bit
hashes in a grouped aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm import word_hashes
from vacansift.llm.arrow_text import pieces, utf8
from vacansift.llm.fm_index import FMIndex, RangeMinimum
from vacansift.llm.shared import saved, text_or_empty, unused
from vacansift.llm.word_hashes import combined, mixed

WINDOW = 50
_GRAM = 16
#: Segments per shard, and the most that one minimizer may bring into a shard.
SHARD_SEGMENTS = 20_000
FILTER_BITS = 25
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _minimizers(words: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest 16-gram of each window."""
    grams = words
    for step in (1, 2, 4, 8):
        grams = combined(grams[:-step], grams[step:])
    place, value = np.arange(len(grams)), grams
    for step in (1, 2, 4, 8, 16, WINDOW - _GRAM + 1 - 32):  # of 2, 4, 8, 16, 32 and at last 35 grams
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value = np.where(left, value[:-step], value[step:])
    return place, grams


def segments(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Segments of the texts (row, start word in the text, number of windows, minimizer, hash of the words, first word in the batch) and all word hashes."""
    data, offsets = utf8(batch.column("text"))
    words, _, _, bounds = word_hashes.words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return {k: none for k in ("row", "start", "windows", "minimizer", "segment", "at")}, words
    place, grams = _minimizers(words)
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    valid = row[: len(place)] == row[WINDOW - 1 :][: len(place)]
    at = np.flatnonzero(valid)
    if not len(at):
        return {k: none for k in ("row", "start", "windows", "minimizer", "segment", "at")}, words
    new = np.concatenate([[True], (np.diff(place[at]) != 0) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    windows = np.diff(np.concatenate([first, [len(at)]]))
    at = at[first]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1])])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), inverse, np.uint64)]))
    ends = at + windows + WINDOW - 1
    content = mixed((sums[ends] - sums[at]) * back[at] + (ends - at).astype(np.uint64))
    return {
        "row": row[at],
        "start": at - bounds[row[at]],
        "windows": windows,
        "minimizer": grams[place[at]].view(np.int64),
        "segment": content.view(np.int64),
        "at": at,
    }, words


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            found, _ = segments(batch)
            rows = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["minimizer"], pa.int64()),
                    pa.array(found["segment"], pa.int64()),
                    batch.column("doc_id").take(rows),
                    batch.column("key").take(rows),
                    pa.array(found["start"], pa.int32()),
                    pa.array(found["windows"], pa.int32()),
                ],
                names=["minimizer", "segment", "doc_id", "key", "start", "windows"],
            )


def _contents(bits: np.ndarray):
    """Words of segments whose minimizer passes the filter, each segment once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in pieces(whole):
                found, words = segments(batch)
                at = found["minimizer"] & ((1 << FILTER_BITS) - 1)
                wanted = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                out = []
                for k in wanted.tolist():
                    name = int(found["minimizer"][k]), int(found["segment"][k])
                    if name not in seen:
                        seen.add(name)
                        a = found["at"][k]
                        out.append((*name, words[a : a + found["windows"][k] + WINDOW - 1].tobytes()))
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                    names=["minimizer", "segment", "words"],
                )

    return run


def matched_windows(texts: list[np.ndarray], owners: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of each window that also occurs in a text of a smaller owner, by backward search in one index of all texts."""
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.zeros(starts[-1], np.int64)  # 0 ends each text
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    symbols[inside] = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1
    index = FMIndex(symbols, window)
    owner = np.repeat(owners, lengths + 1)
    least = RangeMinimum(owner[index.suffixes])
    many = np.maximum(lengths - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = starts[text] + offset
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), index.size, np.int64)
    open_ = np.arange(len(begin))
    for back in range(window - 1, -1, -1):
        low[open_], high[open_] = index.step(symbols[begin[open_] + back], low[open_], high[open_])
        open_ = open_[high[open_] - low[open_] > 1]  # elsewhere only the window's own place is left
    hit = open_[least.of(low[open_], high[open_]) < owner[begin[open_]]] if len(open_) else open_
    return text[hit], offset[hit]


def _search(table: pa.Table) -> pa.Table:
    texts = [np.frombuffer(w.as_buffer(), np.uint64) for w in table.column("words")]
    text, offset = matched_windows(texts, table.column("first").to_numpy())
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text, minlength=len(texts))
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(offset[order], pa.int32())
    )
    return pa.table({"minimizer": table.column("minimizer"), "segment": table.column("segment"), "offsets": lists})


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, offsets, a, b = [], [], [], []
        for row, words in enumerate(batch.column("words")):
            values = np.frombuffer(words.as_buffer(), np.uint64)
            rows.append(np.full(len(values) - WINDOW + 1, row))
            offsets.append(np.arange(len(values) - WINDOW + 1))
            a.append(word_hashes.runs(values, WINDOW))
            b.append(word_hashes.runs(values ^ _BASE, WINDOW))
        if rows:
            rest = batch.select(["minimizer", "segment", "first"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns,
                    pa.array(np.concatenate(offsets), pa.int32()),
                    pa.array(np.concatenate(a).view(np.int64)),
                    pa.array(np.concatenate(b).view(np.int64)),
                ],
                names=["minimizer", "segment", "first", "offset", "a", "b"],
            )


def _overfull(rows: DataFrame) -> DataFrame:
    windows = rows.mapInArrow(_window_hashes, "minimizer long, segment long, first long, offset int, a long, b long")
    least = windows.groupBy("a", "b").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    return (
        windows.join(least, ["a", "b"])
        .where("least < first")
        .groupBy("minimizer", "segment")
        .agg(F.collect_list("offset").alias("offsets"))
    )


def removals(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Stretches to remove: doc_id, key (hash of the text) and ``stretches``, an array of (start, end) in words."""
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.hash(text_or_empty()).alias("key")
    )
    name = ["minimizer", "segment"]
    listed = saved(
        rows.mapInArrow(_list, "minimizer long, segment long, doc_id long, key int, start int, windows int"), "segments"
    )
    shared = (
        listed.groupBy("minimizer")
        .agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
            (F.min("segment") != F.max("segment")).alias("contested"),
        )
        .where("low < high")
        .select("minimizer", "contested")
    )
    places = saved(listed.join(shared, "minimizer"), "shared-segments")
    firsts = saved(places.groupBy(*name).agg(F.min("doc_id").alias("first"), F.max("contested").alias("contested")), "first-segments")
    searched = firsts.where("contested")
    bit = f"pmod(minimizer, {1 << FILTER_BITS})"
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in (
        searched.selectExpr(f"int({bit} div 64) AS word", f"shiftleft(1L, int({bit} % 64)) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    ):
        bits[r["word"]] = r["bits"]
    uses = searched.groupBy("minimizer").agg(F.count("*").alias("uses"))
    contents = rows.select("text").mapInArrow(_contents(bits), "minimizer long, segment long, words binary")
    content = saved(
        searched.join(uses, "minimizer").join(contents.dropDuplicates(name), name), "segment-words"
    )
    few = content.where(F.col("uses") <= shard_segments)
    shards = max(1, -(-few.count() // shard_segments))
    by_index = (
        few.withColumn("shard", F.pmod(F.xxhash64("minimizer"), F.lit(shards)))
        .select("shard", *name, "first", "words")
        .groupBy("shard")
        .applyInArrow(_search, "minimizer long, segment long, offsets array<int>")
    )
    hits = saved(by_index.unionByName(_overfull(content.where(F.col("uses") > shard_segments))).where("size(offsets) > 0"), "matches")
    whole = places.join(firsts.select(*name, "first"), name)
    copies = whole.where("doc_id > first").select(
        "doc_id", "key", "start", (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("end")
    )
    own = (
        whole.where("doc_id = first")
        .join(hits, name)
        .select("doc_id", "key", "start", F.explode("offsets").alias("offset"))
        .select("doc_id", "key", (F.col("start") + F.col("offset")).alias("start"))
        .withColumn("end", F.col("start") + WINDOW)
    )
    return copies.unionByName(own).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("stretches"))


def _cut(columns: list[str], found: str):
    names = [*columns, "text", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts, data = [], utf8(batch.column("text"))
                _, start, end, bounds = word_hashes.words(*data)
                counts, removed, digests = np.diff(bounds), [], []
                for row, stretches in enumerate(batch.column(found).to_pylist()):
                    a, b = bounds[row], bounds[row + 1]
                    keep = np.ones(b - a, bool)
                    for s in stretches or ():
                        keep[s["start"] : s["end"]] = False
                    which = a + np.flatnonzero(keep)
                    kept = b" ".join([data[0][i:j].tobytes() for i, j in zip(start[which].tolist(), end[which].tolist(), strict=True)])
                    removed.append(int(b - a) - len(which))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in columns],
                        pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                    ],
                    names=names,
                )

    return run


def dedup(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """All input columns, ``text`` as the kept words with one blank between, and n_words, n_removed, kept_sha256.

    Words are runs of characters other than white space. A word is removed if a window of 50 words that covers it also starts in a
    document with a smaller doc_id. Null texts have no words and become empty. Rows with a null doc_id neither remove nor lose words; rows that
    repeat an id do not remove each other's. An empty table gives no rows; input columns with the names of results are replaced.
    """
    results = ("text", "n_words", "n_removed", "kept_sha256")
    columns = [c for c in docs.columns if c not in results]
    doc, key, stretches = unused([*docs.columns, *results], "doc", "key", "stretches")
    found = removals(docs.select("doc_id", "text"), shard_segments).select(
        F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("stretches").alias(stretches)
    )
    joined = docs.select(*columns, "text").join(
        found, (F.col("doc_id") == F.col(doc)) & (F.hash(text_or_empty()) == F.col(key)), "left"
    )
    schema = docs.select(*columns).schema.add("text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.select(*columns, "text", stretches).mapInArrow(_cut(columns, stretches), schema.add("kept_sha256", "string"))
