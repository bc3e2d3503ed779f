"""Each operator against brute force, an exact round trip or held-out accuracy."""

import collections
import glob
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacansift.llm import (
    arrow_text, components, fm_index, jaccard_join, language_id, line_dedup, pieces, quality, secrets, substring_dedup, word_hashes,
)
from vacansift.llm.queries_pieces import model_path


def texts_with_copies(seed=5, documents=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for i in range(documents):
        base = rows[rng.randrange(len(rows))][1].split(" ") if rows and rng.random() < 0.5 else None
        if base is None:
            base = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        text = " ".join(base)
        if rng.random() < 0.3:
            text += "\n" + passage + "\t" + rng.choice(words)
        rows.append((i * 3 % documents * 7, text))
    return list({i: (i, t) for i, t in rows}.values())


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_jaccard_components(spark):
    rows = texts_with_copies()
    found = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = split(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(label.values())) < len(label)


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 17, 100, 700):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for _ in range(5):
            drop = rng.integers(0, max(1, n // 9) + 1)
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 62, drop // 2).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            count = {int(t): int(rng.integers(1, 50)) for t in np.union1d(x, y)}
            parts = []
            for s in (x, y):
                own, best = jaccard_join.prefix(s, np.array([count[int(t)] for t in s]))
                parts.append((own, best, len(s) - jaccard_join._needed(len(s))))
            least = min(parts[0][1], parts[1][1])
            shared = np.intersect1d(*[own[: base + least] for own, _, base in parts])
            assert len(shared) >= least


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}}


@pytest.mark.parametrize("shard", [20_000, 2])
def test_substring_dedup(spark, shard):
    rows = texts_with_copies(8)
    found = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard).collect()}
    first = {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    removed = 0
    for i, t in rows:
        w = split(t)
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        assert found[i]["text"] == " ".join(v for v, q in zip(w, keep) if q)
        removed += found[i]["n_removed"]
    assert removed > 500


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 4, rng.integers(3, 60)).astype(np.uint64) for _ in range(40)]
    owners = rng.integers(0, 15, len(texts))
    text, start = substring_dedup.matched_windows(texts, owners, 4)
    seen = collections.defaultdict(set)
    for o, t in zip(owners, texts):
        for k in range(len(t) - 3):
            seen[tuple(t[k : k + 4])].add(o)
    want = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 3) if min(seen[tuple(t[k : k + 4])]) < owners[i]}
    assert set(zip(text.tolist(), start.tolist())) == want


def test_fm_index_intervals():
    symbols = np.array([2, 1, 2, 1, 2, 3, 0])
    index = fm_index.FMIndex(symbols, 8)
    low, high = np.array([0]), np.array([7])
    for symbol in (2, 1, 2):  # the pattern 2 1 2, backwards
        low, high = index.step(np.array([symbol]), low, high)
    assert sorted(index.suffixes[low[0] : high[0]].tolist()) == [0, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_word_hashes_follow_words(texts):
    import pyarrow as pa

    data, offsets = arrow_text.utf8(pa.array(texts))
    hashes, start, end, bounds = word_hashes.words(data, offsets)
    for k, text in enumerate(texts):
        want = split(text)
        got = [data[a:b].tobytes().decode() for a, b in zip(start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]])]
        assert got == want
    by_word = {}
    for h, a, b in zip(hashes.tolist(), start, end):
        assert by_word.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_line_runs(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " d "]) for _ in range(rng.randrange(12)))) for i in range(40)]
    for run in (1, 2, 3, 5):
        found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), run).collect()}
        seen = set()
        for i, text in rows:
            parts = [] if not text.strip() else re.split(r"(?<=\n)(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", text)
            gone = set()
            for k in range(len(parts) - run + 1):
                key = tuple(p.strip() for p in parts[k : k + run])
                if key in seen:
                    gone.update(range(k, k + run))
                seen.add(key)
            assert found[i] == ("".join(p for k, p in enumerate(parts) if k not in gone) if parts else text), (run, i)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model(model_path()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def same_ids(encoder, library, texts):
    ids, offsets = encoder.encode(texts)
    back = pieces.decoded(ids, offsets, encoder.vocabulary)
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want, text
        assert back[k] == library.decode(want)


def test_pieces_on_set_texts(encoder, library):
    same_ids(encoder, library, ["", " ", "  ", None, "▁", " \n ", "=-" * 700 + "#" * 999, "aaaaaaa " * 50, "<s></s><unk><0x41>", "😀漢字\x00"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aeinrst  \n▁=-#é漢", max_size=60)), max_size=6))
def test_pieces_on_any_text(encoder, library, texts):
    same_ids(encoder, library, texts)


def test_forgetting_chunks_changes_nothing(library):
    small = pieces.Encoder(pieces.read_model(model_path()), most_chunks=3)
    for text in ("one two three four five", "five six seven", "one two seven"):
        same_ids(small, library, [text])


def brute_spans(text):
    out = []
    at = 0
    while m := secrets.ASSIGN.search(text, at):
        at = m.end()
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_fixed_patterns():
    rng = random.Random(4)
    parts = ["token", "secret: ", "=", ":", " ", '"', "AKIA", "ABCD1234", "deadbeef" * 4, "é", "Api_Key", "password='", "x", "\n", "ſecret=abcdefgh1"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(14))
        assert sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.KINDS.index(s[0]))) == brute_spans(text)


def secret_texts(n, key):
    rng = random.Random(11)
    words = ["the", "then", "house", "reading", "Other.", "and,", "42", "2021-05-06"]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(40)]
        body.insert(rng.randrange(40), f'{key} = "{"".join(rng.choice("0123456789abcdef") for _ in range(40 if i % 2 else 28))}"')
        out.append(" ".join(body))
    return out


def test_field_adds_what_the_patterns_miss():
    field = secrets.fit(secret_texts(120, "token") + [" ".join(["plain words, 1999"] * 20)] * 40)
    other = secret_texts(30, "credential")
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in other])])
    data = np.frombuffer("".join(other).encode(), np.uint8)
    found = secrets.spans(other, data, offsets, field)
    missed = [t for t, s in zip(other, found) if not secrets.base_spans(t)]
    added = [s for t, s in zip(other, found) if not secrets.base_spans(t) and any(k == "crf" for k, _, _ in s)]
    assert missed and len(added) >= 0.8 * len(missed)
    clean = ["The house and the other reading, 1999 then."] * 3
    tokens = np.frombuffer("".join(clean).encode(), np.uint8), np.arange(4) * len(clean[0])
    assert secrets.spans(clean, *tokens, field) == [[], [], []]


def test_viterbi_is_exact():
    rng = np.random.default_rng(7)
    field = secrets.Field.fresh()
    for w in field.weights():
        w[...] = rng.normal(0, 1.5, w.shape)
    field.file[:, secrets.OUT] += 2
    texts = ["".join(rng.choice(list("ab1 =:.\n"), 30)) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = secrets.tokens(data, np.arange(61) * 30)
    tags, emissions = secrets.viterbi(field, found), field.emissions(found)
    for k in range(60):
        own = np.flatnonzero(found.text == k)
        if len(own) == 0:
            continue

        def value(path):
            moves = sum(field.transitions[a, b] for a, b in zip(path, path[1:]))
            return moves + sum(emissions[i, t] for i, t in zip(own, path))

        best = emissions[own[0]].astype(float)
        for i in own[1:]:
            best = (best[:, None] + field.transitions).max(axis=0) + emissions[i]
        assert abs(value(tags[own].tolist()) - best.max()) < 1e-3


def labelled(seed, n):
    rng = random.Random(seed)
    good = ["the", "thing", "is", "read", "over.", "other", "and", "then,"]
    texts, marks = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 120))]
        texts.append(" ".join(words) if i % 2 else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words)]))
        marks.append(i % 2)
    return texts, marks


def test_quality_on_held_out_texts():
    net = quality.fit(*labelled(1, 200))
    texts, marks = labelled(2, 100)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    scores = quality.scores(net, data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.mean((scores >= 0.5) == np.array(marks)) >= 0.95
    alone = [quality.scores(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts[:10]]
    assert np.allclose(alone, scores[:10], atol=1e-4)  # a score does not depend on the texts around it


def test_quality_gradients():
    net = quality.Network.fresh()
    texts = [np.frombuffer(t.encode(), np.uint8) for t in labelled(3, 6)[0]]
    y, weight = np.array([0, 1] * 3, np.float32), np.ones(6)

    def loss():
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = np.clip(quality.scores(net, np.concatenate(texts), offsets), 1e-7, 1 - 1e-7)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(net.weights(), quality._gradients(net, texts, y, weight)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 3e-3
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.15 * abs(g[at]) + 2e-3


def test_languages_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    prototypes = language_id.learn(docs.where("crc32(cast(doc_id AS string)) % 5 <> 0"))
    held = docs.where("crc32(cast(doc_id AS string)) % 5 = 0 AND lang IS NOT NULL")
    rows = language_id.predict(held, prototypes).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_texts_are_bundled_whole():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(2_000))
    whole, parts = language_id.bundles([text])[0], language_id.bundles([text], block_chars=500)[0]
    assert whole @ parts / np.linalg.norm(whole) / np.linalg.norm(parts) > 0.999


def test_no_operator_is_imported_elsewhere():
    here = os.path.join(os.path.dirname(__file__), "..", "..", "vacansift")
    for path in glob.glob(f"{here}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "vacansift.llm" not in open(path).read(), path
