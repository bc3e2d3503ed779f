"""Awkward inputs: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vacansift.llm import (
    chat_format, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, pieces, quality, secrets, substring_dedup,
)
from vacansift.llm.queries_pieces import model_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key string, n_words long"
LONG = "word " * 40_000 + "x" * 30_000 + "\n" + "é" * 5_000
TEXTS = [
    (1, "The same line here.\nAnother line there.\nThird."), (1, "The same line here.\nAnother line there.\nThird."),
    (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "no id at all, but words enough for one shingle"), (6, "a"),
    (7, "The same line here.\nAnother line there.\nOther end."), (None, None), (8, "12345 !!! ###"), (9, "\x00   😀"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if k % 3 else "en", "s", None, 0.5, "x", "k", 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_model(model_path())


def operators(vocabulary):
    net = quality.fit(["good text", "BAD!! TEXT!!"] * 4, [1, 0] * 4, passes=1)
    return {
        "exact": exact_dedup.exact_groups,
        "contamination": lambda d: decontaminate.contamination(
            d, d.select(F.col("doc_id").alias("item_id"), "text", "key").where("doc_id = 7 OR doc_id IS NULL")
        ),
        "language": lambda d: language_id.predict(d, language_id.learn(d)),
        "secrets": lambda d: secrets.find(d, secrets.train(d)),
        "lines": line_dedup.dedup,
        "quality": lambda d: quality.score(d, net),
        "substring": substring_dedup.dedup,
        "jaccard": jaccard_join.join,
        "pieces": lambda d: pieces.decode(pieces.encode(d, vocabulary), vocabulary),
        "round_trip": lambda d: pieces.round_trip(d, vocabulary),
    }


NAMES = ["exact", "contamination", "language", "secrets", "lines", "quality", "substring", "jaccard", "pieces", "round_trip"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_all_come_back(awkward, vocabulary, name):
    out = operators(vocabulary)[name](awkward).collect()
    assert len(out) == len(TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(awkward, vocabulary, name):
    assert operators(vocabulary)[name](awkward.limit(0)).collect() == []


def test_defined_results_of_awkward_rows(awkward, vocabulary):
    exact = [r for r in exact_dedup.exact_groups(awkward).collect() if r["doc_id"] == 1]
    assert sorted(r["kept"] for r in exact) == [False, True] and {r["group_size"] for r in exact} == {2}
    lines = {r["doc_id"]: r for r in line_dedup.dedup(awkward).collect() if r["doc_id"] is not None}
    assert lines[1]["n_removed"] == 0 and lines[2]["text"] is None and lines[4]["n_lines"] == 0
    assert lines[7]["text"] == "Other end." and lines[7]["n_removed"] == 2
    langs = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(awkward, language_id.learn(awkward)).collect()}
    assert langs[2] == langs[3] == langs[8] == "und"
    joined = {r["doc_id"]: r for r in jaccard_join.join(awkward).collect() if r["doc_id"] is not None}
    assert joined[2]["n_shingles"] == 0 and joined[2]["component_id"] == 2 and joined[6]["n_shingles"] == 1
    coded = {r["doc_id"]: r for r in pieces.round_trip(awkward, vocabulary).collect() if r["doc_id"] is not None}
    assert coded[2]["ids"] == coded[3]["ids"] == [vocabulary.end_id] and coded[5]["decoded"] == LONG
    nothing = [r for r in language_id.predict(awkward, {}).collect()]
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [
        (1, 2, "assistant", "b", "x"), (1, 1, None, None, "x"), (1, None, "user", "first: # <", "x"), (None, 1, "assistant", "\\#", "x"),
        (2, 1, "a: </turn>\n### b", "x" * 300_000, "x"), (1, 2, "assistant", "b", "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    turns = chat_format.format_turns(df).collect()
    assert len(turns) == len(rows)
    parsed = sorted(chat_format.parsed(r["formatted"]) for r in turns)
    assert parsed == sorted((r[2] or "", r[3] or "") for r in rows)
    digests = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    assert digests[1]["n_turns"] == 4 and digests[1]["loss_chars"] == 2 and digests[None]["loss_chars"] == 2
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).collect() == []


def test_pipeline_stages_on_awkward_rows(spark, awkward, tmp_path):
    folder = str(tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Another line there."), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for docs in (awkward.select(*columns), awkward.select(*columns).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "pieces" or out.columns == columns
            assert out.count() <= len(TEXTS)


CLASHING = ["_doc", "_key", "_deleted", "_parts", "_stretches", "_row", "_id", "_missing", "doc", "KEY", "deleted", "parts", "stretches",
    "missing", "id", "digest", "row", "row_number", "component", "b", "token", "label"]


def test_stages_and_operators_with_clashing_columns(spark, awkward, tmp_path):
    folder = str(tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = awkward.select(*columns).withColumns({c: F.lit("x") for c in CLASHING})
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Another line there.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        plain = stage(spark, awkward.select(*columns), folder)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert sorted(map(repr, out.select(*columns).collect())) == sorted(map(repr, plain.collect())), name
    assert substring_dedup.dedup(docs).count() == len(TEXTS)


def test_rows_without_an_id_are_held_out(spark):
    from vacansift.llm.queries_models import held_out

    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long").select("doc_id", held_out(5, 0)).collect()
    assert rows[0]["held_out"] is True and all(isinstance(r["held_out"], bool) for r in rows)
