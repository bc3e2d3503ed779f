"""Document quality by a byte-level convolutional network.

Every byte has a small learned vector. Overlapping chunks of ``2 * STRIDE`` bytes, one every ``STRIDE`` bytes, cover the whole document; learned
filters score each chunk, each filter keeps its maximum over the document, and a hidden layer turns the maxima into one probability.

The network is trained on the driver from a bounded sample of labelled rows; scoring runs over all rows, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm.arrow_text import pieces, utf8
from vacansift.llm.shared import place, thinned

STRIDE = 8
_WIDTH, _FILTERS, _HIDDEN = 4, 32, 16
_PAD = 256
_PIECE_BYTES = 1 << 19  # of text at a time; arrays of a piece take some seventy times as much


@dataclass
class Network:
    """``prior``: the answer where only one class was seen; the weights are then unused."""

    bytes_: np.ndarray
    filters: np.ndarray  # (2 * STRIDE * _WIDTH, _FILTERS)
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float | None = None

    @classmethod
    def fresh(cls, prior: float | None = None) -> Network:
        rng = np.random.default_rng(8)
        size = 2 * STRIDE * _WIDTH

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            normal(_PAD + 1, _WIDTH, scale=0.5),
            normal(size, _FILTERS, scale=size**-0.5),
            np.zeros(_FILTERS, np.float32),
            normal(_FILTERS, _HIDDEN, scale=_FILTERS**-0.5),
            np.zeros(_HIDDEN, np.float32),
            normal(_HIDDEN, scale=_HIDDEN**-0.5),
            np.zeros(1, np.float32),
            prior,
        )

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each document filled up to whole strides, two at least; and the first stride of each document."""
    lengths = np.diff(offsets)
    strides = np.maximum(2, -(-lengths // STRIDE))
    first = np.concatenate([[0], np.cumsum(strides)])
    out = np.full(first[-1] * STRIDE, _PAD, np.int16)
    out[np.repeat(first[:-1] * STRIDE - offsets[:-1], lengths) + np.arange(len(data))] = data
    return out, first


def _chunk_scores(net: Network, padded: np.ndarray) -> np.ndarray:
    """Filter scores of the chunk that starts at each stride (the last stride starts none)."""
    half = STRIDE * _WIDTH
    rows = net.bytes_[padded].reshape(-1, half)
    both = rows @ np.concatenate([net.filters[:half], net.filters[half:]], axis=1)
    return both[:-1, :_FILTERS] + both[1:, _FILTERS:]


def _maxima(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest score of each filter in each document; chunks across two documents are left out."""
    bounds = np.column_stack([first[:-1], first[1:] - 1]).ravel()
    return np.maximum.reduceat(np.vstack([scores, scores[-1:]]), bounds, axis=0)[::2]


def _answer(net: Network, maxima: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pooled = np.maximum(maxima + net.filter_bias, 0)
    hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    return pooled, hidden, 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each document."""
    if net.prior is not None:
        return np.full(len(offsets) - 1, net.prior)
    padded, first = _padded(data, offsets)
    return _answer(net, _maxima(_chunk_scores(net, padded), first))[2].astype(float)


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    padded, first = _padded(np.concatenate(texts), offsets)
    chunk_scores = _chunk_scores(net, padded)
    where = np.array([a + chunk_scores[a : b - 1].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
    pooled, hidden, probability = _answer(net, np.take_along_axis(chunk_scores, where, axis=0))
    d_logit = ((probability - labels) * weight / len(texts)).astype(np.float32)
    d_hidden = np.outer(d_logit, net.out) * (hidden > 0)
    d_pooled = (d_hidden @ net.hidden.T) * (pooled > 0)
    chunks = padded[where[:, :, None] * STRIDE + np.arange(2 * STRIDE)]  # (document, filter, byte)
    inputs = net.bytes_[chunks].reshape(len(texts), _FILTERS, -1)
    d_filters = np.einsum("dfi,df->if", inputs, d_pooled)
    d_inputs = (d_pooled[:, :, None] * net.filters.T[None]).reshape(-1, _WIDTH)
    d_bytes = np.stack(
        [np.bincount(chunks.ravel(), d_inputs[:, k], minlength=_PAD + 1) for k in range(_WIDTH)], axis=1
    )
    return [
        d_bytes, d_filters, d_pooled.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_logit,
        d_logit.sum(keepdims=True),
    ]


def fit(texts: list[str | None], labels: list[int], passes: int = 12, batch: int = 24, rate: float = 4e-3) -> Network:
    """Train with Adam; both classes weigh the same. With one class or no row the answer is that class, or 0.5."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Network.fresh(float(y[0]) if len(y) else 0.5)
    net = Network.fresh()
    rng = np.random.default_rng(9)
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    share = np.where(y == 1, y.mean(), 1 - y.mean())
    weight = 0.5 / share
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step, steps = 0, passes * -(-len(data) // batch)
    for _ in range(passes):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for w, g, (m, v) in zip(
                net.weights(), _gradients(net, [data[i] for i in some], y[some], weight[some]), moments, strict=True
            ):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, most_chars: int = 20_000) -> Network:
    """Train on at most ``rows_per_class`` labelled rows of each class with at most ``most_chars`` characters.

    The caller chooses which labels may be learned from. Rows are drawn by a hash of their id, so the sample does not change with the order
    of the files. Labels other than 0 and 1 and texts that are null are passed over; ids that are missing from ``docs`` too. A label
    that repeats counts once.
    """
    chosen = None
    usable = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    draw = F.xxhash64("doc_id")
    found = usable.agg(*[F.count_if(F.col("quality") == value).alias(f"n{value}") for value in (0, 1)]).first()
    for value in (0, 1):
        some = (
            usable.where((F.col("quality") == value) & thinned(draw, found[f"n{value}"], rows_per_class))
            .orderBy(place(draw), "doc_id")
            .limit(rows_per_class)
        )
        chosen = some if chosen is None else chosen.unionByName(some)
    marks: dict[int, set[int]] = {}
    for r in chosen.collect():
        marks.setdefault(r["doc_id"], set()).add(r["quality"])
    clear = {i: next(iter(q)) for i, q in marks.items() if len(q) == 1}
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("doc_id").isin(list(clear)) & (F.length("text") <= most_chars))
        .orderBy("doc_id", "text")
        .limit(2 * rows_per_class)
        .collect()
    )
    return fit([r["text"] for r in rows], [clear[r["doc_id"]] for r in rows])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All input columns and ``score``, the probability that the text deserves label 1, from the bytes of the whole text alone.

    Null and empty texts are scored like a text of padding. An empty table gives no rows; an input column ``score`` is replaced.
    """
    columns = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, limit=_PIECE_BYTES):
                found = pa.array(scores(net, *utf8(batch.column("text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*columns, "score"])

    schema = docs.select(*columns).schema.add("score", "double")
    return docs.select(*columns).mapInArrow(run, schema)
