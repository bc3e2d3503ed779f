"""Long passages on one line are repeated runs as well."""

import random
import re

import corpus_pipeline
from vacansift.llm import line_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_line_is_a_run_of_its_own(spark):
    passage, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    texts = {
        1: f"one\n{passage}\ntwo\n{short}\nthree", 2: f"four\n  {passage}\nfive", 3: passage, 4: f"six\n{short}\nseven",
        5: f"{passage}\neight\n{passage}\n",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], COLUMNS)
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert found == {1: (texts[1], 0), 2: ("four\nfive", 1), 3: ("", 1), 4: (texts[4], 0), 5: ("eight\n", 2)}
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {1: (texts[1], len(texts[1])), 2: ("four\nfive", 9), 4: (texts[4], len(texts[4])), 5: ("eight\n", 6)}


def test_line_runs_by_lines_or_words(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b c", "d e f", "", " g "]) for _ in range(rng.randrange(9)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run, words in ((2, 3), (3, 4), (5, 5)):
        found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, run, words).collect()}
        seen = set()
        for i, text in rows:
            parts = [] if not text.strip() else re.split(r"(?<=\n)(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", text)
            gone = set()
            for length in range(1, run + 1):
                for k in range(len(parts) - length + 1):
                    key = tuple(p.strip() for p in parts[k : k + length])
                    if length < run and len(" ".join(key).split()) < words:
                        continue
                    if key in seen:
                        gone.update(range(k, k + length))
                    seen.add(key)
            assert found[i] == ("".join(p for k, p in enumerate(parts) if k not in gone) if parts else text), (run, i)
