"""The gate comes before scoring: what it drops is neither scored nor carried on, and changes no result."""

from pyspark.sql import functions as F
from test_store import DAY, LISTING, LISTINGS, scan_inputs

from vacansift.operators import collect, scoring
from vacansift.plans import scan


def test_remote_rows_are_neither_scored_nor_carried_on(spark):
    listings, store, details = scan_inputs(spark)
    judged = scan.judge(listings, store, details, DAY)
    remote = judged.where("remote")
    assert remote.count() > 0 and remote.where("category = 'FORM4'").count() > 0
    empty = [c for c in judged.columns if c not in ("source_url", "seq", "category", "eligibility", "remote", "rejected", "inserts", "fills")]
    shown = remote.select(*[F.count(c).alias(c) for c in empty]).first().asDict()
    assert {c: n for c, n in shown.items() if n} == {}


def test_other_rows_are_scored_as_without_the_gate(spark):
    rows = [
        ("PSC", f"u{n}", title, "C & D", location, text, "Contract", DAY, None, "ICT", n)
        for n, (title, location, text, _) in enumerate(LISTINGS)
    ]
    listings = spark.createDataFrame(rows, LISTING)
    none = spark.createDataFrame([], "source_url string, body string, qualifications array<string>, experience string")
    judged = scan.judge(listings, listings.select("source_url").where("false"), none, DAY)
    scored = scoring.score_postings(collect.with_category(listings), DAY).where(~scoring.is_remote())
    fields = ["source_url", "title", "description", "score", "tier", "eligibility", "skills", "matched_locations"]
    want = sorted(map(repr, scored.select(*fields, F.col("reasons").alias("reason_list")).collect()))
    got = sorted(map(repr, judged.where("not remote").select(*fields, "reason_list").collect()))
    assert got == want and 0 < len(got) < len(LISTINGS)
