"""Token counts against the library on whole texts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tokenizers import Tokenizer  # noqa: E402

from vacansift.llm import token_counts  # noqa: E402
from vacansift.llm.queries import QUERIES  # noqa: E402
from vacansift.llm.queries_pieces import model_path  # noqa: E402

PATH = model_path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def definition():
    return token_counts.read(PATH)


def made_texts():
    rng = random.Random(4)
    alphabets = [
        "abcdefghij ", "the of and to in ", "xX", "aあ漢字、。 ", "ẹ́ö ", "한국어 텍스트 ", "각 ", "0123456789", "'sdtrevml ",
        "=-!?'", "😀👍🏽 ", "ไทยกำลังดี", "İıſẞ ", "<|endoftext|> ", "a'", "  \t \n",
    ]
    texts = []
    for alphabet in alphabets:
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(900, 2500))))
    for _ in range(30):
        parts = []
        while sum(map(len, parts)) < 1500:
            alphabet = rng.choice(alphabets)
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))))
            parts.append(rng.choice(["", " ", "<|endoftext|>", "<|startoftext|>", "\n", "'s", "'ll "]))
        texts.append("".join(parts))
    texts += ["x" * 5000, "ab" * 3000, "\u0301" * 3000, "=" * 4000, " " * 4000, "<|endoftext|>" * 300, "e" + "\u0301" * 700 + " word " * 300]
    return texts


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (1024, 32), (1 << 16, 1024)])
def test_spliced_counts_equal_the_library(spark, library, definition, chunk, overlap):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in token_counts.count_tokens(docs, definition, chunk, overlap).collect()}
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [found[i]["n_tokens"] for i in range(len(texts))] == want
    assert [found[i]["n_bytes"] for i in range(len(texts))] == [len(t.encode()) for t in texts]


def test_borders_without_a_common_token_are_widened(spark, library, definition):
    # The last cut of the run falls off the period of its tokens, so the overlap has no common token.
    text = "intro " + "x" * 6001 + " end " * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("digest", F.sha2("text", 256))
    pieces = token_counts._long_pieces(docs.withColumn("dropped", F.lit(None).cast("array<long>")), 500, 21, [])
    borders = token_counts._borders(token_counts._encoded(pieces, definition))
    assert borders.where("excess IS NULL").count() > 0
    counted = token_counts.count_tokens(docs, definition, 500, 21).first()["n_tokens"]
    assert counted == len(library.encode(text, add_special_tokens=False).ids)


def test_awkward_rows(spark, library, definition):
    long = "Long text, " * 400
    rows = [(1, long, 5), (1, long, 6), (None, long, 7), (None, None, 8), (2, None, 9), (3, "", 0), (4, " \n", 1), (5, "a", 2), (5, "a", 2), (6, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    docs = docs.withColumns({"digest": F.lit("x"), "start": F.lit(1), "piece": F.lit("y"), "n_bytes": F.lit(None)})
    out = token_counts.count_tokens(docs, definition, 256, 32)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted(
        ((i or 0), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows
    )
    assert sorted(((r[0] or 0), r[1], r[2]) for r in out.collect()) == want
    assert token_counts.count_tokens(docs.limit(0), definition, 256, 32).collect() == []


def test_query_equals_the_library(spark, library):
    found = {r["doc_id"]: r for r in QUERIES["op12_token_counts"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[doc_id]["n_tokens"], found[doc_id]["over_limit"]) == (n, n > 2048)


def test_other_tokenizers_are_refused(tmp_path, definition):
    rules = json.loads(definition)
    rules["model"]["merges"] = rules["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError, match="proper"):
        token_counts.read(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="proven"):
        token_counts.read(model_path("byte_bpe_50k.json"))
