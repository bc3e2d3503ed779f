"""Token counts of documents of any length, by overlap resynchronisation.

Short texts are counted in the task that reads them, spliced at every blank, a stable border that needs no overlap, so that a word is encoded once
however often it occurs. A text of more than ``chunk_chars`` is cut into chunks that reach ``overlap_chars`` into the
next one. The chunks are dealt out over the cluster, encoded with offsets by the tokenizer library, and spliced where both encodings of an overlap
have a token in common. Where an overlap has none, it is widened to the whole next chunk and encoded again, until every border fits.

Why a common token proves the splice. Chunks start and end where composition (NFC) can't reach across and no added token is cut, so what is
encoded is a stretch of the whole normalised text. The rest of the normalisation works on single characters and white space. The word pattern takes
runs of one kind of character, single digits and English endings of at most three characters, so a scan that starts anywhere sees the ends of words as the
scan of the whole text does, but for its first three characters. Inside a word the merges are proper: each token is made by one merge, later than
those that make its parts. For such merges a sequence of tokens is the encoding of its text if and only if every two neighbours are, taken alone. Left
tokens up to a common token and right tokens after it have only neighbours that stand next to each other in one of the encodings. ``read`` refuses
tokenizers for which this argument has not been made.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansift.llm.arrow_text import pieces as text_pieces
from vacansift.llm.shared import saved, text_or_empty

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1024
#: Characters at the start of a chunk that an English ending cut in two may change.
MARGIN = 3
_BATCH_BYTES = 1 << 20
#: Words with known counts that a worker keeps; beyond that it forgets them all.
_KEPT_WORDS = 400_000

#: The word pattern that the proof above is about.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase"]

_TOKEN = "struct<start:long,end:long,id:int,through:long>"
_PIECE = "digest string, start long, stop long, head_end long, piece string"


def read(path: str) -> str:
    """The definition of a tokenizer, read on the driver; tasks get its text. Raises ValueError where the splice isn't proven."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    _check(json.loads(definition))
    return definition


def _check(rules: dict) -> None:
    model, steps = rules["model"], (rules.get("normalizer") or {}).get("normalizers", [])
    words = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    plain = model["type"] == "BPE" and not (
        model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges")
    )
    known = [s["type"] for s in steps] == _STEPS and words.get("pattern") == {"Regex": WORDS}
    if not plain or not known or rules.get("truncation") or rules.get("padding"):
        raise ValueError("splices are proven for byte-pair merges on NFC, lower-cased words only")
    end = model.get("end_of_word_suffix") or ""
    made = set()
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        parts_known = all(len(p.removesuffix(end)) == 1 or p in made for p in (left, right))
        if not parts_known or left + right in made:
            raise ValueError(f"the merge {left} {right} is not proper")
        made.add(left + right)
    for token in rules.get("added_tokens", []):
        if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"the added token {token['content']} isn't taken from the text as it is")


@cache
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@cache
def _known_words(definition: str) -> dict[str, int]:
    return {}


def _word_counts(words: list[str], definition: str) -> np.ndarray:
    """Tokens of each word; words not met before are encoded together, with a blank between."""
    known = _known_words(definition)
    if len(known) > _KEPT_WORDS:
        known.clear()
    fresh = [w for w in words if w not in known]
    if fresh:
        encoding = _tokenizer(definition).encode(" ".join(fresh), add_special_tokens=False)
        offsets = np.fromiter((start for start, _ in encoding.offsets), np.int64, len(encoding))
        borders = np.cumsum([0, *(len(w) + 1 for w in fresh)])
        known.update(zip(fresh, np.diff(np.searchsorted(offsets, borders)).tolist(), strict=True))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _counts(texts: pa.Array, definition: str) -> np.ndarray:
    """Tokens of each text, by its words between ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    tokens = _word_counts(words.dictionary.to_pylist(), definition)[words.indices.to_numpy()]
    return np.diff(np.concatenate([[0], np.cumsum(tokens)])[lists.offsets.to_numpy()])


@cache
def _joining() -> frozenset[str]:
    """Characters that composition may join to the one before them, or that this Unicode version doesn't know."""
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    return frozenset(second)


def _starts_anew(char: str) -> bool:
    if char < "\u0300":
        return True
    first = unicodedata.normalize("NFD", char)[0]
    return not unicodedata.combining(first) and unicodedata.category(char) != "Cn" and not {char, first} & _joining()


def _clean(text: str, at: int, added: list[str]) -> int:
    """The first place from ``at`` on where a chunk may start or end."""
    while at < len(text):
        cut = [t for t in added if text.find(t, max(0, at - len(t) + 1), at + len(t) - 1) >= 0]
        if not cut and _starts_anew(text[at]):
            break
        at += 1
    return min(at, len(text))


def _cuts(text: str, chunk: int, overlap: int, added: list[str]) -> list[tuple[int, int]]:
    """(start, end of the overlap from there on) of every chunk; the first has no overlap, all others end after they start."""
    places = [(0, 0)]
    for at in range(chunk, len(text), chunk):
        start = _clean(text, at, added)
        end = _clean(text, start + overlap, added)
        if start >= places[-1][0] + chunk // 2 and places[-1][1] <= start and start < len(text):
            places.append((start, end))
    return places


def _spans(text: str, dropped: list[int] | None, chunk: int, overlap: int, added: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """start, next start, end of the head's overlap, end of the chunk. With ``dropped`` starts, chunks that grew over one of them only."""
    gone = set(dropped or [])
    places = [p for p in _cuts(text, chunk, overlap, added) if p[0] not in gone]
    following = [*places[1:], (len(text), len(text))]
    for (start, head_end), (stop, end) in zip(places, following, strict=True):
        if dropped is None or any(start < d < stop for d in gone):
            yield start, stop, head_end, end


def _encoded_piece(encoding, start: int, stop: int, head_end: int, end: int) -> tuple[int, list[dict], list[dict]]:
    """Number of tokens, and those of the overlaps at head and tail that cover whole characters."""
    ids, offsets = encoding.ids, encoding.offsets

    def overlap(first: int, last: int) -> list[dict]:
        low, high = first - start + MARGIN, last - start
        found = []
        lo = _first_from(offsets, low)
        for k in range(lo, len(ids)):
            a, b = offsets[k]
            if b >= high:
                break
            alone = (k == 0 or offsets[k - 1][1] <= a) and (k + 1 == len(ids) or offsets[k + 1][0] >= b)
            if a < b and alone:
                found.append({"start": a + start, "end": b + start, "id": ids[k], "through": k + 1})
        return found

    return len(ids), overlap(start, head_end) if start else [], overlap(stop, end) if end > stop else []


def _first_from(offsets: list[tuple[int, int]], low: int) -> int:
    a, b = 0, len(offsets)
    while a < b:
        middle = (a + b) // 2
        if offsets[middle][0] < low:
            a = middle + 1
        else:
            b = middle
    return a


def _long_pieces(docs: DataFrame, chunk: int, overlap: int, added: list[str]) -> DataFrame:
    """Chunks of long texts, one row each: doc_id, digest, start, stop, head_end, piece."""
    narrow = docs.select("doc_id", "digest", "dropped", "text")
    doc_type = narrow.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema(
        [("digest", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("head_end", pa.int64()), ("piece", pa.string())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, digest = batch.column("text")[k].as_py(), batch.column("digest")[k].as_py()
                rows, size = [], 0
                spans = list(_spans(text, batch.column("dropped")[k].as_py(), chunk, overlap, added))
                for n, (start, stop, head_end, end) in enumerate(spans):
                    rows.append(dict(zip(arrow.names, (digest, start, stop, head_end, text[start:end]), strict=True)))
                    size += end - start
                    if size > _BATCH_BYTES or n + 1 == len(spans):
                        made = pa.RecordBatch.from_pylist(rows, arrow)
                        ids = batch.column("doc_id").take(pa.array([k] * len(rows)))
                        yield pa.RecordBatch.from_arrays([ids, *made.columns], names=["doc_id", *arrow.names])
                        rows, size = [], 0

    return narrow.mapInArrow(cut, f"doc_id {doc_type}, {_PIECE}")


def _encoded(pieces: DataFrame, definition: str) -> DataFrame:
    """Every chunk once, with its number of tokens and the tokens of its overlaps; equal rows of a table share their chunks."""
    doc_type = pieces.schema["doc_id"].dataType.simpleString()
    token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("id", pa.int32()), ("through", pa.int64())])
    names = ["doc_id", "digest", "start", "stop", "n", "head", "tail"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition)
        for whole in batches:
            for batch in text_pieces(whole, "piece", _BATCH_BYTES):
                columns = [batch.column(c).to_pylist() for c in ("start", "stop", "head_end", "piece")]
                counts, heads, tails = [], [], []
                for start, stop, head_end, piece in zip(*columns, strict=True):
                    encoding = tokenizer.encode(piece, add_special_tokens=False)
                    n, head, tail = _encoded_piece(encoding, start, stop, head_end, start + len(piece))
                    counts.append(n)
                    heads.append(head)
                    tails.append(tail)
                made = [pa.array(counts, pa.int64()), pa.array(heads, pa.list_(token)), pa.array(tails, pa.list_(token))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:4]] + made, names=names)

    dealt = pieces.groupBy("doc_id", "digest", "start").agg(F.first(F.struct("stop", "head_end", "piece")).alias("p"))
    return dealt.select("doc_id", "digest", "start", "p.*").mapInArrow(
        encode, f"doc_id {doc_type}, digest string, start long, stop long, n long, head array<{_TOKEN}>, tail array<{_TOKEN}>"
    )


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.digest") == F.col(f"{right}.digest"))


def _borders(encoded: DataFrame) -> DataFrame:
    """doc_id, digest, cut, excess: tokens that both sides of a border have together, beyond those of the splice; null without a common token."""
    left = encoded.select("doc_id", "digest", F.col("stop").alias("cut"), "n", "tail").alias("l")
    right = encoded.where("start > 0").select("doc_id", "digest", F.col("start").alias("cut"), "head").alias("r")
    joined = left.join(right, _same("l", "r") & (F.col("l.cut") == F.col("r.cut"))).select(
        "l.doc_id", "l.digest", "l.cut", "n", "tail", "head"
    )
    place = lambda t: F.struct(t["start"], t["end"], t["id"])
    common = F.array_min(F.array_intersect(F.transform("tail", place), F.transform("head", place)))
    found = joined.withColumn("common", common)

    def through(tokens: str) -> Column:
        return F.filter(tokens, lambda t: (t["start"] == F.col("common")["start"]) & (t["id"] == F.col("common")["id"]))[0]["through"]

    excess = F.when(F.col("common").isNotNull(), F.col("n") - through("tail") + through("head"))
    return found.select("doc_id", "digest", "cut", excess.alias("excess"))


def _long_counts(docs: DataFrame, definition: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, digest, n_tokens of the long texts."""
    added = [t["content"] for t in json.loads(definition)["added_tokens"]]
    key = ["doc_id", "digest"]
    encoded = saved(
        _encoded(_long_pieces(docs.withColumn("dropped", F.lit(None).cast("array<long>")), chunk, overlap, added), definition),
        "token-chunks",
    )
    gone = None
    while True:
        borders = saved(_borders(encoded), "token-borders")
        failed = borders.where("excess IS NULL").select(*key, "cut")
        if failed.isEmpty():
            break
        gone = failed if gone is None else saved(gone.unionByName(failed), "token-dropped")
        # Only documents with a border that failed now are read again; all their cuts that ever failed stay away.
        now = failed.select(*key).distinct().alias("n")
        lists = gone.groupBy(*key).agg(F.array_sort(F.collect_set("cut")).alias("dropped")).alias("g")
        lists = saved(lists.join(now, _same("g", "n"), "left_semi"), "token-again").alias("f")
        again = docs.alias("d").join(lists, _same("d", "f")).select("d.doc_id", "d.digest", "d.text", "dropped")
        grown = _encoded(_long_pieces(again, chunk, overlap, added), definition)
        cuts = failed.alias("c")
        whole = encoded.alias("e")
        kept = whole.join(
            cuts, _same("e", "c") & ((F.col("e.start") == F.col("c.cut")) | (F.col("e.stop") == F.col("c.cut"))), "left_anti"
        )
        fresh = grown.alias("w").join(
            kept.select("doc_id", "digest", "start").alias("k"), _same("w", "k") & (F.col("w.start") == F.col("k.start")), "left_anti"
        )
        encoded = saved(kept.unionByName(fresh), "token-chunks")
    parts = encoded.select(*key, "n").unionByName(borders.select(*key, (-F.col("excess")).alias("n")))
    return parts.groupBy(*key).agg(F.sum("n").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, definition: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, as the library counts without begin, end or added special tokens.

    ``definition`` comes from :func:`read`. A null text is empty and has no tokens. Strings of added tokens inside a text count as that token, the
    library's default. Rows that repeat an id and a text come back as often as they stand there, encoded once where they are long; a null id stays null. Other columns
    are ignored, whatever their names, and an empty table gives no rows. No text is cut short: a text without a common token at any
    border, such as one endless word, ends up as one chunk.
    """
    chunk, overlap = chunk_chars, overlap_chars
    if overlap <= MARGIN or chunk < 4 * overlap:
        raise ValueError("chunks need an overlap of more than three characters and four times its length")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    doc_type = texts.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_pieces(whole):
                n = pa.array(_counts(batch.column("text"), definition), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = texts.where(F.length("text") <= chunk).select("doc_id", n_bytes, "text")
    short = short.mapInArrow(count, f"doc_id {doc_type}, n_bytes long, n_tokens long")
    long = texts.where(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    # Equal rows are counted before they are joined with their one result, so that no key is hot in the join.
    rows = long.groupBy("doc_id", "digest").agg(F.first(n_bytes).alias("n_bytes"), F.count("*").cast("int").alias("times")).alias("a")
    counts = _long_counts(long, definition, chunk, overlap).alias("b")
    joined = rows.join(counts, _same("a", "b")).select("a.doc_id", "n_bytes", "n_tokens", "times")
    back = joined.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")
    return short.unionByName(back)
