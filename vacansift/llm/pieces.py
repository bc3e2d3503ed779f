"""SentencePiece BPE encoding and decoding with a table of prefixes' last tokens.

Every prefix of a text has one encoding, and so one last token. It is the only token that ends there and is compatible with the last
token of the prefix before it: two tokens are compatible when merging the text of both never joins them. So one pass from left to right stores
the last token of each prefix (candidates come from an Aho-Corasick automaton over the vocabulary), and the ids are read
backwards from the end, jumping by token lengths. No merge queue is needed, and time is linear in the text.

No piece has a blank after another character, and characters outside the vocabulary take part in no merge, so texts are encoded in
chunks of blanks and a word; each distinct chunk of a task is encoded once, all new chunks of a batch together in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vacansift.llm.arrow_text import pieces as text_pieces

_BLANK = "▁"
_NONE = -np.inf
_PIECE_BYTES = 1 << 20  # of text at a time; arrays of ids take some forty times as much


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces with scores, byte pieces, and the end id."""

    normal: tuple[tuple[int, str, float], ...]
    byte_ids: tuple[int, ...]
    surfaces: tuple[bytes, ...]  # what each id decodes to
    end_id: int


def read_model(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback, a dummy prefix and no other normalisation (on the driver; a few hundred KB)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_ids, surfaces = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surfaces.append(bytes([int(piece[3:5], 16)]))
        elif model.is_unknown(i):
            surfaces.append(" ⁇ ".encode())
        elif model.is_control(i):
            surfaces.append(b"")
        else:
            normal.append((i, piece, model.get_score(i)))
            surfaces.append(piece.replace(_BLANK, " ").encode())
            if _BLANK in piece.lstrip(_BLANK):
                raise ValueError(f"piece {i} has a blank inside; chunks would not be independent")
    return Vocabulary(tuple(normal), tuple(byte_ids), tuple(surfaces), model.eos_id())


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``lengths[k]`` entries from ``starts[k]`` on, for all k, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Hash:
    """Fixed map from non-negative int64 keys to floats, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE)
        self.probes = 1
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slots = slot[left]
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[left[free]]  # of several keys for one slot the last wins
            won = self.keys[slots] == keys[left]
            self.values[slots[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _merge_history(text: str, score: dict[str, float]) -> tuple[list[str], list[str], list[float]]:
    """First and last symbol before each merge of a piece's own text, and the score of the merge (none after the last)."""
    symbols = list(text)
    firsts, lasts, scores = [], [], []
    while True:
        firsts.append(symbols[0])
        lasts.append(symbols[-1])
        best, at = _NONE, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (at < 0 or s > best):
                best, at = s, i
        scores.append(best)
        if at < 0:
            return firsts, lasts, scores
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class PrefixTable:
    """Automaton and compatibility tests of a vocabulary. Tokens are numbered by themselves; ``ids`` has the ids of each."""

    def __init__(self, vocabulary: Vocabulary, memo_bits: int = 20):
        score = {piece: s for _, piece, s in vocabulary.normal}
        number: dict[str, int] = {}

        def symbol(text: str) -> int:
            return number.setdefault(text, len(number))

        texts, ids, starts, firsts, lasts, scores = [], [], [], [], [], []
        self.known = {sign for _, piece, _ in vocabulary.normal for sign in piece}
        of_piece = {piece: (i,) for i, piece, _ in vocabulary.normal}
        for sign in self.known - set(of_piece):  # a character that only longer pieces hold falls back to bytes
            of_piece[sign] = tuple(vocabulary.byte_ids[b] for b in sign.encode())
        for piece, own_ids in of_piece.items():
            first, last, steps = _merge_history(piece, score)
            if first[-1] != piece:
                continue  # merging its text gives other tokens, so it never comes out
            starts.append(len(scores))
            firsts += [symbol(f) for f in first]
            lasts += [symbol(x) for x in last]
            scores += steps
            texts.append(piece.encode())
            ids.append(own_ids)
        self.starts, self.firsts, self.lasts = (np.array(x, np.int64) for x in (starts, firsts, lasts))
        self.scores = np.array(scores)
        splits = [
            ((number[piece[:k]] << 20) | number[piece[k:]], s)
            for piece, s in score.items()
            for k in range(1, len(piece))
            if piece[:k] in number and piece[k:] in number
        ]
        self.merges = _Hash(np.array([k for k, _ in splits], np.int64), np.array([s for _, s in splits]))
        self.memo_bits = memo_bits
        self.memo_keys = np.full(1 << memo_bits, -1, np.int64)
        self.memo_values = np.zeros(1 << memo_bits, bool)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.id_starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        self.ids = np.array([x for i in ids for x in i], np.int32)
        self._automaton(texts)

    def _automaton(self, texts: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        for token, text in enumerate(texts):
            node = 0
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = children[node][byte]
            token_at[node] = token
        nodes = len(children)
        self.step = np.zeros((nodes, 256), np.int32)
        fail = np.zeros(nodes, np.int64)
        self.longest = np.full(nodes, -1, np.int64)  # longest token that ends at a node
        self.shorter = np.full(len(texts), -1, np.int64)  # next shorter token that ends a token
        level = [(0, -1, -1)]
        while level:
            below = []
            for node, parent, byte in level:
                if parent > 0:
                    fail[node] = self.step[fail[parent], byte]
                if node:
                    self.step[node] = self.step[fail[node]]
                    self.longest[node] = self.longest[fail[node]]
                    if token_at[node] >= 0:
                        self.shorter[token_at[node]] = self.longest[node]
                        self.longest[node] = token_at[node]
                for b, child in children[node].items():
                    self.step[node, b] = child
                    below.append((child, node, b))
            level = below

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the texts of both tokens together leaves both: both merge histories run in the order of their scores,
        and the symbols at the border must never be the best pair (the leftmost of equals is)."""
        i, j = self.starts[left], self.starts[right]
        ok = np.ones(len(left), bool)
        open_ = np.arange(len(left))
        while len(open_):
            a, b = i[open_], j[open_]
            next_a, next_b = self.scores[a], self.scores[b]
            across = self.merges.get((self.lasts[a] << 20) | self.firsts[b])
            joined = (across > next_a) & (across >= next_b)
            ok[open_[joined]] = False
            go = ~joined & ((next_a > _NONE) | (next_b > _NONE))
            open_, on_left = open_[go], (next_a >= next_b)[go]
            i[open_[on_left]] += 1
            j[open_[~on_left]] += 1
        return ok

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As above; answers for pairs met before come from a table of fixed size."""
        keys = (left << 20) | right
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.memo_bits)).astype(np.int64)
        out = self.memo_values[slots]
        missing = np.flatnonzero(self.memo_keys[slots] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            answers = self._compatible(new >> 20, new & 0xFFFFF)
            out[missing] = answers[back]
            self.memo_values[slots[missing]] = out[missing]
            self.memo_keys[slots[missing]] = keys[missing]
        return out

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of known characters, and offsets of the chunks; all chunks of similar length advance byte by byte together."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(sizes, kind="stable")
        ascending = sizes[order]
        found, counts, at = [], [], 0
        while at < len(order):
            size = max(1, int(ascending[at]))
            end = min(int(np.searchsorted(ascending, max(16, 2 * size), "right")), at + 1 + 4_000_000 // size)
            group = order[at:end][::-1].copy()  # longest first
            order[at:end] = group
            tokens, many = self._group([chunks[c] for c in group])
            found.append(tokens)
            counts.append(many)
            at = end
        if not found:
            return self.ids[:0], np.zeros(1, np.int64)
        tokens, counts = np.concatenate(found), np.concatenate(counts)
        token_starts, own = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.empty(len(order), np.int64)
        own[order] = np.arange(len(order))
        tokens = tokens[ranges(token_starts[own], counts[own])]
        offsets = np.concatenate([[0], np.cumsum(counts[own])])
        widths = self.id_starts[tokens + 1] - self.id_starts[tokens]
        id_offsets = np.concatenate([[0], np.cumsum(widths)])
        return self.ids[ranges(self.id_starts[tokens], widths)], id_offsets[offsets]

    def _group(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in chunks], np.int64)
        most = int(lengths[0])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(chunks), np.uint8)
        last = np.full((most, len(chunks)), -1, np.int32)
        state = np.zeros(len(chunks), np.int64)
        for p in range(most):
            n = int(np.searchsorted(-lengths, -p, "left"))  # chunks longer than p
            state[:n] = self.step[state[:n], data[starts[:n] + p]]
            token = self.longest[state[:n]]
            row = np.flatnonzero(token >= 0)
            token = token[row]
            while len(row):
                before = p - self.sizes[token]
                first = before < 0
                previous = np.where(first, 0, last[np.maximum(before, 0), row]).astype(np.int64)
                fits = first | (previous >= 0)
                ask = np.flatnonzero(fits & ~first)
                fits[ask] = self.compatible(previous[ask], token[ask])
                last[p, row[fits]] = token[fits]
                token, row = self.shorter[token[~fits]], row[~fits]
                row, token = row[token >= 0], token[token >= 0]
        # Backwards: jump from the end by the length of the last token.
        place, rows, taken = lengths - 1, np.arange(len(chunks)), []
        while len(rows):
            token = last[place[rows], rows].astype(np.int64)
            taken.append((rows, token))
            place[rows] -= self.sizes[token]
            rows = rows[place[rows] >= 0]
        of = np.concatenate([r for r, _ in taken])
        token = np.concatenate([t for _, t in taken])
        order = np.lexsort((-np.arange(len(of)), of))  # later finds stand further left
        return token[order], np.bincount(of, minlength=len(chunks))


class Encoder:
    """Encodes texts; ids of distinct chunks are kept up to ``most_chunks``, then forgotten."""

    _RUNS = re.compile(r" *[^ ]+| +$")

    def __init__(self, vocabulary: Vocabulary, most_chunks: int = 120_000):
        self.vocabulary = vocabulary
        self.table = PrefixTable(vocabulary)
        self.most_chunks = most_chunks
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.table.known)))}])")
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = [0]

    def _learn(self, words: list[str]) -> None:
        """Encode new words, each with a blank before it, and give them codes."""
        chunks, words_of_one, mixed = [], [], []
        search = self.unknown.search
        for word in words:
            chunk = _BLANK + (word.replace(" ", _BLANK) if " " in word else word)
            if search(chunk):
                mixed.append((word, self.unknown.split(chunk)))
            else:
                words_of_one.append(word)
                chunks.append(chunk.encode())
        one = len(chunks)
        parts: dict[str, int] = {}
        for _, split in mixed:
            for part in split[::2]:
                if part:
                    parts.setdefault(part, len(parts))
        ids, offsets = self.table.encode(chunks + [p.encode() for p in parts])
        new, ends = [ids[: offsets[one]]], (offsets[1 : one + 1] + self.ends[-1]).tolist()
        end = self.ends[-1] + int(offsets[one])
        for _, split in mixed:
            for k, part in enumerate(split):
                if k % 2:
                    own = np.array([self.vocabulary.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")], np.int32)
                elif part:
                    at = one + parts[part]
                    own = ids[offsets[at] : offsets[at + 1]]
                else:
                    continue
                new.append(own)
                end += len(own)
            ends.append(end)
        start = self.ends[-1]
        self.codes.update(zip(words_of_one + [w for w, _ in mixed], range(len(self.ends) - 1, len(self.ends) - 1 + len(words)), strict=True))
        self.ends += ends
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.empty(end, np.int32)])
        self.ids[start:end] = np.concatenate(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and offsets of the texts."""
        lists = []
        for text in texts:
            text = (text or "").replace(_BLANK, " ")
            words = text.split(" ") if text else []
            if "" in words:  # blanks in a row or at an end belong to the next word
                words = [w[1:] for w in self._RUNS.findall(" " + text)]
            lists.append(words)
        distinct = set().union(*lists) if lists else set()
        if len(self.codes) > self.most_chunks:
            self._forget()
        new = [w for w in distinct if w not in self.codes]
        if new:
            self._learn(new)
        get = self.codes.__getitem__
        codes = np.array([c for words in lists for c in map(get, words)], np.int64)
        ends = np.array(self.ends)
        widths = ends[codes + 1] - ends[codes]
        cumulative = np.concatenate([[0], np.cumsum(widths)])
        flat = self.ids[ranges(ends[codes], widths)]
        text_ends = cumulative[np.cumsum([len(words) for words in lists], dtype=np.int64)] if lists else np.zeros(0, np.int64)
        ids = np.insert(flat, text_ends, self.vocabulary.end_id)
        return ids.astype(np.int32), np.concatenate([[0], text_ends + np.arange(1, len(lists) + 1)])


@lru_cache(2)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All input columns and ``ids``: the ids of the whole text, the end id last.

    Null and empty texts have the end id alone. An input column ``ids`` is replaced; an empty table gives no rows.
    """
    return _encode(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: all input columns, ``ids`` and ``decoded``, decoded from these ids.

    One Python worker per core holds the tables, instead of one for each of two steps.
    """
    return _encode(docs, vocabulary, True)


def _encode(docs: DataFrame, vocabulary: Vocabulary, back: bool) -> DataFrame:
    results = ["ids", "decoded"] if back else ["ids"]
    columns = [c for c in docs.columns if c not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for whole in batches:
            for batch in text_pieces(whole, limit=_PIECE_BYTES):
                ids, offsets = encoder.encode(batch.column("text").to_pylist())
                made = [_id_lists(ids, offsets)]
                if back:
                    made.append(pa.array(decoded(ids, offsets, vocabulary), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, *results])

    schema = docs.select(*columns).schema.add("ids", ArrayType(IntegerType()))
    return docs.select(*columns).mapInArrow(run, schema.add("decoded", "string") if back else schema)


def decoded(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of id lists: surfaces joined, without the blank that encoding put before the text."""
    sizes = np.array([len(s) for s in vocabulary.surfaces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(vocabulary.surfaces), np.uint8)
    widths = sizes[ids]
    cumulative = np.concatenate([[0], np.cumsum(widths)])
    raw = data[ranges(starts[ids], widths)].tobytes()
    ends = cumulative[offsets].tolist()
    return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All input columns and ``decoded``, the text of ``ids``. Null and empty lists give an empty text; an input column ``decoded`` is
    replaced. Bytes that are no UTF-8 become U+FFFD."""
    columns = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column("ids").to_numpy(zero_copy_only=False)
                lists = [np.zeros(0, np.int32) if x is None else x for x in lists]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
                texts = decoded(np.concatenate(lists), offsets, vocabulary)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return rows.select(*columns).mapInArrow(run, rows.select(*columns).schema.add("decoded", "string"))


def joined_ids():
    """The ids as decimal numbers with one blank between."""
    return F.array_join(F.col("ids").cast("array<string>"), " ")
