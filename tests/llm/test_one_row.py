"""One row of each component, with repeated and null ids."""

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_component(spark):
    same = " ".join(f"w{k}" for k in range(60))
    near, other = same + " more", " ".join(f"v{k}" for k in range(60))
    texts = [
        (7, same, "a"), (7, same, "b"), (7, other, "c"), (7, other + " more", "d"), (9, near, "e"), (None, near, "f"), (None, same, "g"),
        (None, "no partner of any kind", "h"), (None, "no partner of any kind", "i"), (None, None, "j"), (None, "", "k"), (8, " ", "l"), (8, " ", "m"),
        (10, "", "n"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in texts], COLUMNS).coalesce(1)
    left = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert left == [(0, ""), (0, "no"), (7, "v0"), (7, "w0"), (8, " "), (10, "")]
