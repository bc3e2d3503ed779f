"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as outside, begin or inside of a secret. A token's emission adds learned weights of its shape (length, kinds of characters,
changes between them), of the words around it and of the file (how much of it looks like settings); transitions are learned too.
It is trained on the driver on windows of a bounded sample, labelled by the fixed patterns, and on copies of these windows in which another
key or none stands before another kind of random value, or an ordinary word, number, date, address or name stands in its place. Neighbours and file
features are masked at random, so that shape and surroundings each carry weight. Tokens of the sample that look like values but match no
pattern are left out of the training, since they may be just what the patterns miss: values of other keys, of other alphabets, without a key.

Decoding is Viterbi. A token whose lead for "outside" exceeds anything transitions could give is outside in every best path, so whole
texts are decoded exactly by solving only the stretches between such tokens, all stretches of a batch together.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm.arrow_text import pieces, utf8
from vacansift.llm.shared import place, thinned

# Fixed values.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = range(3)
_SHAPES, _WORDS, _FILES = 8 * 8 * 3 * 2 * 3 * 3, 4096, 16
_AROUND = (-4, -3, -2, -1, 1, 2)

SPANS = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, in code points."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _character_kinds() -> np.ndarray:
    """0 white space, 1 part of a word, 2 a token of its own."""
    kinds = np.full(256, 2, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    for sign in "+/_.-":
        kinds[ord(sign)] = 1
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = 1
    kinds[128:] = 1
    return kinds


def _one_hot(signs: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[ord(s) for s in signs]] = 1
    return table


_KIND = _character_kinds()
_LOWER = _one_hot("abcdefghijklmnopqrstuvwxyz")
_UPPER = _one_hot("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _one_hot("0123456789")
_HEX = _one_hot("0123456789abcdef")
_JOIN = _one_hot("./-")
_UNDER = _one_hot("_+")
_FOLD = np.arange(256) + 32 * _UPPER
_MIX = np.random.default_rng(4).integers(1, 1 << 62, (16, 256), dtype=np.uint64)


@dataclass
class Tokens:
    """Tokens of some texts, one after another: places in the bytes, feature numbers, and the text of each."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    file: np.ndarray  # of each text


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    texts = len(offsets) - 1
    kind = _KIND[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = (kind == 2) | ((kind == 1) & (first | np.concatenate([[True], kind[:-1] != 1])))
    start = np.flatnonzero(begins)
    solid = np.flatnonzero(kind > 0)
    none = np.zeros(0, np.int64)
    if not len(start):
        return Tokens(none, none, none, none, none, np.zeros(texts, np.int64))
    signs = data[solid]
    at = np.searchsorted(solid, start)  # first sign of each token among the solid ones
    length = np.diff(np.concatenate([at, [len(solid)]]))
    within = np.arange(len(solid)) - np.repeat(at, length)

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.int32), at)

    lower, upper, digit, hexa = (total(t[signs]) for t in (_LOWER, _UPPER, _DIGIT, _HEX))
    is_digit = _DIGIT[signs]
    changes = total(np.concatenate([[False], is_digit[1:] != is_digit[:-1]]) & (within > 0))
    size = np.searchsorted([2, 4, 8, 12, 16, 20, 32], length, "right")
    kinds = (lower > 0) * 4 + (upper > 0) * 2 + (digit > 0)
    share = np.where(digit == 0, 0, np.where(digit * 2 < length, 1, 2))
    turn = np.searchsorted([1, 3], changes, "right")
    joined = np.where(total(_JOIN[signs]) > 0, 2, total(_UNDER[signs]) > 0)
    shape = ((((size * 8 + kinds) * 3 + share) * 2 + (hexa == length)) * 3 + turn) * 3 + joined
    mixed = np.add.reduceat(_MIX[within & 15, _FOLD[signs]], at)
    word = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(_WORDS)).astype(np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    count = np.maximum(np.bincount(text, minlength=texts), 1)
    settings = np.bincount(text, (data[start] == ord("=")) | (data[start] == ord(":")), minlength=texts) / count
    digits = np.bincount(text, digit > 0, minlength=texts) / count
    file = np.searchsorted([0.002, 0.02, 0.1], settings, "right") * 4 + np.searchsorted([0.01, 0.05, 0.2], digits, "right")
    return Tokens(start, start + length, text, shape, word, file)


@dataclass
class Field:
    """Weights of the random field; each table has one row per feature and one column per tag."""

    shape: np.ndarray
    around: np.ndarray  # (place, word, tag)
    file: np.ndarray
    transitions: np.ndarray

    @classmethod
    def fresh(cls) -> Field:
        field = cls(
            np.zeros((_SHAPES, 3), np.float32),
            np.zeros((len(_AROUND), _WORDS + 1, 3), np.float32),
            np.zeros((_FILES, 3), np.float32),
            np.zeros((3, 3), np.float32),
        )
        field.file[:, OUT] = 4  # with nothing learned, nothing is a secret
        return field

    def weights(self) -> list[np.ndarray]:
        return [self.shape, self.around, self.file, self.transitions]

    def emissions(self, found: Tokens) -> np.ndarray:
        out = self.shape[found.shape] + self.file[found.file[found.text]]
        for place, shift in enumerate(_AROUND):
            out += self.around[place][neighbours(found, shift)]
        return out


def neighbours(found: Tokens, shift: int) -> np.ndarray:
    """Word number of the token ``shift`` places on in the same text; _WORDS where there is none."""
    out = np.full(len(found.word), _WORDS, np.int64)
    here, there = (slice(None, -shift), slice(shift, None)) if shift > 0 else (slice(-shift, None), slice(None, shift))
    same = found.text[here] == found.text[there]
    out[here] = np.where(same, found.word[there], _WORDS)
    return out


def viterbi(field: Field, found: Tokens) -> np.ndarray:
    """Best tag of every token."""
    tags = np.zeros(len(found.start), np.int8)
    if not len(tags):
        return tags
    emissions, t = field.emissions(found), field.transitions
    gain_before = max(0.0, float((t[:, 1:] - t[:, :1]).max()))
    gain_after = max(0.0, float((t[1:] - t[:1]).max()))
    certain = emissions[:, OUT] - emissions[:, 1:].max(axis=1) > gain_before + gain_after
    open_ = np.flatnonzero(~certain)
    if not len(open_):
        return tags
    same = (np.diff(open_) == 1) & (found.text[open_[1:]] == found.text[open_[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    length = np.diff(np.concatenate([first, [len(open_)]]))
    order = np.argsort(-length, kind="stable")
    begin, length = open_[first[order]], length[order]
    # A stretch is bounded by certain tokens or by the ends of its text.
    inner = (begin > 0) & (found.text[np.maximum(begin - 1, 0)] == found.text[begin])
    best = emissions[begin] + np.where(inner[:, None], t[OUT][None], 0)
    came = [None]
    for step in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -step, "left"))
        paths = best[:n, :, None] + t[None]
        came.append(paths.argmax(axis=1).astype(np.int8))
        best[:n] = paths.max(axis=1) + emissions[begin[:n] + step]
    stop = begin + length
    more = (stop < len(tags)) & (found.text[np.minimum(stop, len(tags) - 1)] == found.text[begin])
    tag = (best + np.where(more[:, None], t[:, OUT][None], 0)).argmax(axis=1)
    for step in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -step, "left"))
        tags[begin[:n] + step] = tag[:n]
        if step:
            tag[:n] = came[step][np.arange(n), tag[:n]]
    return tags


def marginals(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each tag at each place of each window (forward and backward sums, scaled at every place), and expected counts of tag pairs."""
    near = np.exp(emissions - emissions.max(axis=2, keepdims=True), dtype=np.float64)
    moves = np.exp(transitions, dtype=np.float64)
    length = near.shape[1]
    forward, backward = near.copy(), np.ones_like(near)
    for k in range(1, length):
        forward[:, k] *= forward[:, k - 1] @ moves
        forward[:, k] /= forward[:, k].sum(axis=1, keepdims=True)
    for k in range(length - 2, -1, -1):
        backward[:, k] = (near[:, k + 1] * backward[:, k + 1]) @ moves.T
        backward[:, k] /= backward[:, k].sum(axis=1, keepdims=True)
    chances = forward * backward
    chances /= chances.sum(axis=2, keepdims=True)
    left, right = forward[:, :-1], (near * backward)[:, 1:]
    whole = ((left @ moves) * right).sum(axis=2, keepdims=True)
    both = moves * ((left / whole).reshape(-1, 3).T @ right.reshape(-1, 3))
    return chances, both


def _fit(features: list[np.ndarray], tags: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximise the likelihood of windows of equal length by Adam. features: shape, file and each neighbour, (window, place)."""
    field = Field.fresh()
    rng = np.random.default_rng(6)
    windows, length = tags.shape
    truth = np.eye(3, dtype=np.float32)[tags]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in field.weights()]
    for step in range(1, steps + 1):
        hidden = rng.random((len(features) - 2, windows)) < 0.25
        around = [np.where(h[:, None], _WORDS, f) for h, f in zip(hidden, features[2:], strict=True)]
        file = np.where(rng.random((windows, 1)) < 0.5, rng.integers(0, _FILES, (windows, 1)), features[1])
        e = field.shape[features[0]] + field.file[file]
        for place, f in enumerate(around):
            e = e + field.around[place][f]
        chances, both = marginals(e, field.transitions)
        wrong = truth - chances
        flat = wrong.reshape(-1, 3)
        tables = [(features[0], _SHAPES), *[(f, _WORDS + 1) for f in around], (file, _FILES)]
        sums = [np.stack([np.bincount(f.ravel(), flat[:, k], minlength=n) for k in range(3)], axis=1) for f, n in tables]
        gradients = [sums[0], np.stack(sums[1:-1]), sums[-1], pairs - both]
        for w, g, (m, v) in zip(field.weights(), gradients, moments, strict=True):
            g = g / windows - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _random_value(rng: random.Random) -> str:
    """A value as generators of keys make them: one alphabet, both letters and digits, sometimes a prefix or padding."""
    letters, digits = string.ascii_letters, string.digits
    alphabet, least, most = rng.choice(
        [
            ("0123456789abcdef", 20, 64),
            ("0123456789ABCDEF", 20, 64),
            (letters + digits, 14, 48),
            (letters + digits, 14, 48),
            (string.ascii_lowercase + digits, 16, 40),
            (string.ascii_uppercase + digits, 14, 40),
            (letters + digits + "+/", 24, 64),
            (letters + digits + "-_", 24, 48),
        ]
    )
    body = "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most) - 4))
    kept = [c for c in alphabet if c.isalpha()]
    value = f"{rng.choice(kept)}{rng.choice(digits)}{body}{rng.choice(digits)}{rng.choice(kept)}"
    if rng.random() < 0.35:
        value = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 4))) + rng.choice("_-") + value
    return value


def _random_plain(rng: random.Random, words: list[str]) -> str:
    """Something ordinary that may stand where a value does."""
    word, other = (rng.choice(words).strip(string.punctuation).lower() or "word" for _ in range(2))
    n, m = rng.randint(0, 99), rng.randint(1, 12)
    return rng.choice(
        [
            word,
            word.capitalize() + other.capitalize() + str(n),
            word.upper(),
            f"{word}_{other}_{n}",
            f"{word.upper()}_{other.upper()}",
            f"{word}-{other}",
            str(rng.randint(0, 10 ** rng.randint(1, 16))),
            f"20{n:02}-{m:02}-{m + 9:02}",
            f"20{n:02}-{m:02}-{m + 9:02}T{m:02}:{n % 60:02}:00Z",
            f"+{m}-{n:02}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
            f"{m}.{n}.{m + 1}",
            f"{word}.{n}@{other}{m}.example.com",
            f"https://www.{word}{m}.org/20{n:02}/{other}-{n}/{word}.html",
            f"{word}/{other}/{word}{n}.txt",
            f"{word}{n}",
        ]
    )


def _made(rng: random.Random, words: list[str], key: str, secret: bool) -> tuple[str, int, int]:
    """A short text around a random value or something ordinary, and where that stands."""
    value = _random_value(rng) if secret else _random_plain(rng, words)
    name = rng.choice([key, rng.choice(words), "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 12)))])
    link = rng.choice([" = ", "=", ": ", ":", " ", " is ", " := "])
    quote = rng.choice(["", "", '"', "'"])
    before = rng.choices(words, k=rng.choice([0, 3, 14])) + ([] if rng.random() < 0.3 else [name + link.rstrip(" ")])
    lead = " ".join(before) + ("" if link in ("=", ":") else " ") + quote
    after = quote + rng.choice(["", ".", "\n", ","]) + " " + " ".join(rng.choices(words, k=rng.choice([0, 3, 14])))
    return lead + value + after, len(lead), len(lead) + len(value)


def fit(texts: list[str], reach: int = 6, plain_per_text: int = 3, made: int = 6) -> Field:
    """Train on windows around the fixed patterns' values and on others without any, on ``made`` windows with a random value and twice as many
    with something ordinary for each of them (at least 800 and at most 2,400 with a value)."""
    keys = [m[1] for t in texts for m in ASSIGN.finditer(t)]
    words = [w for t in texts for w in t[:2_000].split()[:40] if len(w) < 30 and not base_spans(w)]
    matched = sum(bool(base_spans(t)) for t in texts)
    if not matched or not words:
        return Field.fresh()
    rng, chance = np.random.default_rng(5), random.Random(5)
    count = min(max(made * matched, 800), 2_400) if made else 0
    extra = [_made(chance, words, chance.choice(keys or ["key"]), k < count) for k in range(3 * count)]
    raw = [t.encode() for t in [*texts, *(t for t, _, _ in extra)]]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = tokens(np.frombuffer(b"".join(raw), np.uint8), offsets)
    tags = np.zeros(len(found.start), np.int64)
    centres: list[int] = []

    def covered(k: int, text: str, a: int, b: int) -> tuple[int, int]:
        first = offsets[k] + len(text[:a].encode())
        i, j = np.searchsorted(found.start, [first, first + len(text[a:b].encode())])
        return int(i), int(j)

    for k, text in enumerate(texts):
        values = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        values += [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]
        for a, b in sorted(values):
            i, j = covered(k, text, a, b)
            if i < j and not tags[i:j].any():
                tags[i:j] = INSIDE
                tags[i] = BEGIN
                centres.append(i)
    for k, (text, a, b) in enumerate(extra):
        i, j = covered(len(texts) + k, text, a, b)
        if i < j and k < count:
            tags[i:j] = INSIDE
            tags[i] = BEGIN
        centres.append(i)
    starts = np.searchsorted(found.text, np.arange(len(texts) + 1))
    # A token without a match that looks like values and like nothing ordinary may be a value: it counts for neither.
    made_plain = (found.text >= len(texts)) & (tags == 0)
    doubtful = (tags == 0) & np.isin(found.shape, np.setdiff1d(found.shape[tags > 0], found.shape[made_plain]))
    before = np.concatenate([[0], np.cumsum(doubtful)])
    for first, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if first < stop and plain_per_text:
            drawn = rng.integers(first, stop, plain_per_text)
            clear = before[np.minimum(drawn + reach + 1, len(tags))] == before[np.maximum(drawn - reach, 0)]
            centres += drawn[clear].tolist()
    whole = [found.shape, found.file[found.text], *[neighbours(found, s) for s in _AROUND]]
    index = np.clip(np.array(centres)[:, None] + np.arange(-reach, reach + 1), 0, len(tags) - 1)
    return _fit([f[index] for f in whole], tags[index])


def train(docs: DataFrame, rows: int = 800, most_chars: int = 20_000) -> Field:
    """Train on at most ``rows`` texts that hold a match of a fixed pattern and as many others, of at most ``most_chars``
    characters each, drawn by a hash of id and text; rows that repeat both count once. Without a match in the table nothing is added to
    the fixed patterns."""
    likely = F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("draw"), likely.alias("likely")).where(
        F.length("text").between(1, most_chars)
    )
    draws = texts.select("draw", "likely").distinct()
    found = draws.agg(F.count_if("likely").alias("with"), F.count_if(~F.col("likely")).alias("without")).first()
    wanted = F.when(F.col("likely"), thinned(F.col("draw"), found["with"], rows)).otherwise(
        thinned(F.col("draw"), found["without"], rows)
    )
    chosen = texts.where(wanted).distinct().select("text", "likely", place(F.col("draw")).alias("place"))
    drawn = sorted(chosen.collect(), key=lambda r: (r["place"], r["text"]))
    return fit([r["text"] for kind in (True, False) for r in [r for r in drawn if r["likely"] is kind][:rows]])


def spans(texts: list[str], data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, in code points, by start and kind. A span of the field that touches a fixed one is left out."""
    found = tokens(data, offsets)
    tags = viterbi(field, found)
    inside = np.flatnonzero(tags > 0)
    extra: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(inside):
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        joins = (tags[inside] == INSIDE) & np.concatenate(
            [[False], (np.diff(inside) == 1) & (found.text[inside[1:]] == found.text[inside[:-1]])]
        )
        first = np.flatnonzero(~joins)
        last = np.concatenate([first[1:], [len(inside)]]) - 1
        text = found.text[inside[first]]
        a = before[found.start[inside[first]]] - before[offsets[text]]
        b = before[found.end[inside[last]]] - before[offsets[text]]
        for k, i, j in zip(text.tolist(), a.tolist(), b.tolist(), strict=True):
            extra[k].append((i, j))
    out = []
    for text, more in zip(texts, extra, strict=True):
        own = base_spans(text)
        own += [("crf", i, j) for i, j in more if not any(a < j and i < b for _, a, b in own)]
        out.append(sorted(own, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (kind, start, end) in code points of the whole text, end exclusive.

    ``assign``, ``access`` and ``hex`` are the fixed patterns' matches, leftmost and not overlapping within a kind; ``crf`` are spans
    the field adds. Null and empty texts have none. Rows are scanned one by one, also those that repeat, and keep their doc_id, null
    included. Other columns are ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = spans(texts, *utf8(batch.column("text")), field)
                values = [[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(values, kind)], names=["doc_id", "spans"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")
