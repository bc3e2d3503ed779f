"""Training samples."""

from vacansift.llm import quality, secrets


def test_samples_are_the_same_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda texts, labels: set(texts))
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text").cache()

    def drawn(ids, times):
        labels = spark.range(ids).selectExpr("id AS doc_id", "1 AS quality", f"explode(sequence(1, {times})) AS k")
        return quality.train(docs, labels, rows_per_class=100)

    assert len(drawn(1000, 10)) == 100
    assert len(drawn(400, 1) - drawn(401, 1)) <= 1
    monkeypatch.setattr(secrets, "fit", set)
    found = [secrets.train(docs.where(f"doc_id < {n}").crossJoin(spark.range(times)), rows=100) for n, times in ((400, 1), (401, 1), (401, 10))]
    assert len(found[0] - found[1]) <= 1 and found[1] == found[2] and len(found[1]) == 100
