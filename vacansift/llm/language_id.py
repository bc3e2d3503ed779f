"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram is the product (binding) of its letters' vectors, each rotated by its place;
a document is the sum (bundle) of its trigrams, a language the sum of its documents' unit vectors; and a document goes to the language
with the largest cosine. Runs of other characters are one word boundary, which is a letter of its own.

A block of documents is one matrix product: trigram counts times trigram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm.arrow_text import pieces

DIMENSIONS = 512
_CODES = 128
_SEED = 20
_UNIT = 1 << 20  # unit vectors are summed as integers, so that the order of summing doesn't matter
_UNKNOWN = "und"


@lru_cache(1)
def _letter_codes() -> np.ndarray:
    """Code of each code point: 0 for what is no letter, 1-26 for a-z, shared codes for other letters."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()[0]
            table[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (_CODES - 27)
    return table


class _Trigrams:
    """Vectors of the trigrams met so far; the store is bounded and starts anew when full."""

    def __init__(self, room: int = 1 << 14):
        letters = np.random.default_rng(_SEED).choice(np.array([-1, 1], np.float32), (_CODES, DIMENSIONS))
        self.places = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.room, self.used = room, 0
        self.row = np.full(_CODES**3, -1, np.int32)
        self.vectors = np.empty((room, DIMENSIONS), np.float32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > self.room:
            return self._make(grams)
        new = grams[self.row[grams] < 0]
        if self.used + len(new) > self.room:
            self.row[:], self.used, new = -1, 0, grams
        self.row[new] = np.arange(self.used, self.used + len(new))
        self.vectors[self.used : self.used + len(new)] = self._make(new)
        self.used += len(new)
        return self.vectors[self.row[grams]]

    def _make(self, grams: np.ndarray) -> np.ndarray:
        first, second, third = self.places
        return first[grams >> 14] * second[(grams >> 7) & 127] * third[grams & 127]


@lru_cache(1)
def _trigrams() -> _Trigrams:
    return _Trigrams()


def _bundle(texts: list[str]) -> np.ndarray:
    """Vectors of a few texts (rows of zeros where there is no letter)."""
    own = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    joined = "\n" + "\n\n".join(texts) + "\n"  # a boundary before and after each text
    codes = _letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    keep = (codes > 0) | first | np.concatenate([[True], codes[:-1] > 0])
    codes, own = codes[keep].astype(np.int32), own[keep]
    if len(codes) < 3:
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    grams = (codes[:-2] << 14) | (codes[1:-1] << 7) | codes[2:]
    inside = (own[:-2] == own[2:]) & (grams > 0)
    grams, own = grams[inside], own[:-2][inside]
    present = np.zeros(_CODES**3, bool)
    present[grams] = True
    distinct = np.flatnonzero(present)
    column = np.empty(_CODES**3, np.int32)
    column[distinct] = np.arange(len(distinct))
    counts = np.bincount(own * len(distinct) + column[grams], minlength=len(texts) * len(distinct))
    return counts.reshape(len(texts), -1).astype(np.float32) @ _trigrams().of(distinct)


def bundles(texts: list[str | None], block_chars: int = 200_000, block_rows: int = 64) -> np.ndarray:
    """Document vectors. Texts longer than a block are bundled in parts of a block's size."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    rows, parts, chars = [], [], 0

    def flush() -> None:
        nonlocal rows, parts, chars
        if parts:
            np.add.at(out, rows, _bundle(parts))
        rows, parts, chars = [], [], 0

    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), block_chars):
            part = text[at : at + block_chars]
            rows.append(row)
            parts.append(part)
            chars += len(part)
            if chars >= block_chars or len(parts) >= block_rows:
                flush()
    flush()
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in pieces(whole):
            vectors = np.rint(_unit(bundles(batch.column("text").to_pylist())) * _UNIT).astype(np.int64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
            names=["lang", "vector"],
        )


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of each language from all rows with a text and a ``lang``; the driver gets one vector per language.

    A language whose documents have no letters is not learned.
    """
    sums = (
        docs.select("text", "lang")
        .where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(_learn, "lang string, vector array<long>")
        .select("lang", F.posexplode("vector"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("total"))
        .collect()
    )
    found: dict[str, np.ndarray] = {}
    for r in sums:
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["pos"]] = r["total"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine with the chosen prototype, at least 0).

    Only the text is looked at. Null texts and texts without a letter get ``und`` and 0, as does every row if nothing was learned; ties go
    to the first language by name. Other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                vectors = _unit(bundles(batch.column("text").to_pylist()))
                if names:
                    cosines = vectors @ matrix.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                else:
                    best, score = np.zeros(len(vectors), int), np.zeros(len(vectors))
                known = vectors.any(axis=1) & bool(names)
                langs = [names[b] if k else _UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
