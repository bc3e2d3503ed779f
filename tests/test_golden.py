"""Known verdicts for single postings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacansift.functions import places, qualification
from vacansift.operators import qualify, scoring

AS_OF = dt.date(2026, 9, 1)

POSTINGS = [
    (
        1, "Web Developer, Junior", "Nairobi, Kenya",
        "A small shop in Nairobi, Kenya wants pages in html and css, with javascript and react on top. "
        "This is an entry-level seat, no experience required.",
        "KENYA", "KENYA", 87, "strong",
    ),
    (
        2, "IT Support Officer", "Remote / Worldwide",
        "Answers the help desk of a remote company: it support, hardware troubleshooting, networking. Entry-level. "
        "You may work from anywhere worldwide.",
        "REMOTE-WORLDWIDE", "REMOTE-WORLDWIDE", 92, "strong",
    ),
    (
        3, "Senior Platform Engineer", "United States Only",
        "10+ years of node.js and postgresql. US residents only. A Master's degree required.",
        "REMOTE-RESTRICTED", "REMOTE-RESTRICTED", 0, "poor",
    ),
    (
        4, "Android Developer", "Africa",
        "Phone apps in kotlin and java, made for East Africa. An entry-level seat.",
        "REMOTE-AFRICA", "UNKNOWN", 69, "consider",
    ),
]


def test_scores(spark):
    rows = [(i, t, l, d, "", None) for i, t, l, d, *_ in POSTINGS]
    df = spark.createDataFrame(
        rows,
        "id int, title string, location string, description string, "
        "employment_type string, posted_date date",
    )
    out = scoring.score_postings(df, AS_OF).orderBy("id").collect()
    for row, want in zip(out, POSTINGS):
        bare = row["place_rule"].split(":")[0]
        bare = "REMOTE-RESTRICTED" if bare == "RESTRICTED" else bare
        assert (bare, row["eligibility"], row["score"], row["tier"]) == want[4:], row
    assert out[2]["blockers"][0] == "Restricted to US"
    assert out[0]["reasons"][-1] == "Eligibility: KENYA"
    assert len(out[2]["blockers"]) == 3


@pytest.mark.parametrize(
    "title, location, description, expected",
    [
        ("Remote Customer Agent", "Nairobi", "", True),
        ("Agent", "Work from home", "", True),
        ("Field Officer", "Nairobi", "Travel to remote areas of the county", False),
        ("Annotator", "Nairobi", "A fully remote position", True),
        ("Analyst", "Nairobi", "You can work from anywhere in the world", True),
        ("Agent", "Nairobi", "work from home", True),
        ("Shop Attendant", "Nairobi", None, False),
        (None, None, None, False),
    ],
)
def test_remote(spark, title, location, description, expected):
    df = spark.createDataFrame(
        [(title, location, description)], "title string, location string, description string"
    )
    got = df.select(places.looks_remote(F.col("title"), F.col("location"), F.col("description")))
    assert got.first()[0] is expected


#: Words of each class of requirement, in the order in which the classes are tried within a sentence.
ASKED = {
    "degree required": ("HND", "an MBA", "university graduate"),
    "diploma required": ("diploma",),
    "extra certificate required": ("CCNA", "a trade test", "proficiency in bookkeeping"),
    "licence required": ("a firearm permit", "PSV badge", "driving permit"),
    "professional registration required": ("registration by the council",),
}
UNASKED = (
    "birth certificate", "certificate of clearance", "school leaving certificate", "certificates & testimonials", "KCPE certificates",
    "photocopies of original supporting documents", "certificate of secondary education", "good conduct certificate",
)
LICENSED = ("Rider", "Laboratory Technologist", "Swahili teacher", "Pharmaceutical sales", "Junior counselor", "Mechanic (night shift)")
SIGNS = {"+": ("+", " plus", " (plus)"), "-": ("-", " minus", " (minus)"), "": ("", " plain", " (plain)")}


def verdict_cases():
    """(title, text, reason or level; None: accepted at either level): the branches of the rules, combined."""
    for label, words in ASKED.items():
        for word in words:
            yield "Store keeper", f"Needs {word}.", label
            yield "Store keeper", f"Good with people; {word} optional.", "likely"
            yield "Store keeper", f"Form four or {word}!", "confirmed"
            yield "Store keeper", f"Morning or evening, {word}!", label
            yield "Store keeper", f"Form four or older! Also {word}", label
            yield "Baker - " + word, "Form four.", label
    for first, words in ASKED.items():
        for second, others in ASKED.items():
            earlier = min(first, second, key=list(ASKED).index)
            yield "Sorter", f"{words[0]}, {others[-1]}", earlier
            yield "Sorter", f"{words[0]}? {others[-1]}", first
    for words in UNASKED:
        yield "Usher", f"Carry your {words}", None
    for title in LICENSED:
        yield title, "form 4, diploma", "role normally needs a licence or qualification"
    for wording in ("mean of", "grade of at least", "minimum grade"):
        for grade in ("A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "E"):
            for sign in SIGNS[grade[1:]]:
                above = grade[0] in "AB" or grade == "C+"
                yield "Tea picker", f"kcse, {wording} {grade[0]}{sign}.", f"KCSE grade {grade} required" if above else "confirmed"
    yield "Tea picker", "k.c.s.e mean of e plus", "confirmed"  # no such grade
    yield "Tea picker", "kcse minimum grade a month ago", "confirmed"  # an article
    yield "Tea picker", "kcpe mean of C; form iv mean of B-; kcse mean of a.", "KCSE grade A required"  # the strictest
    yield "Tea picker", "Pay grade of A. Form four.", "confirmed"  # a sentence without school


def test_verdicts(spark):
    cases = list(verdict_cases())
    rows = [(i, t, d) for i, (t, d, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, title string, description string").selectExpr(
        "*", "cast(null as string) body", "cast(null as array<string>) qualifications",
        "cast(null as string) experience",
    )
    out = qualify.evaluate(df).orderBy("id").collect()
    assert len(out) == len(cases) > 150
    for row, (title, text, want) in zip(out, cases, strict=True):
        got = row["level"] if row["ok"] else row["reject_reason"]
        assert row["ok"] if want is None else got == want, (title, text, want, row)


def test_no_grade_in_lower_case_prose(spark):
    df = spark.createDataFrame([("kcse with a minimum of three terms",)], "t string")
    assert df.select(qualification.required_grade(F.col("t"))).first()[0] is None


@pytest.mark.parametrize(
    "location, title, expected",
    [
        ("Malindi", None, 0), ("Mtwapa", None, 0), ("Kilifi", None, 0), ("Watamu", None, 0),
        ("Mombasa", None, 1), ("Nairobi", None, 2), ("Kenya", "Cleaner - Lavington", 2),
        ("Eldoret", None, 3), ("Narok", None, 4), ("Maasai Mara", None, 4),
        ("Nairobi, Mombasa, Malindi", None, 0), ("Kericho", "Support Staff", 9),
        ("Kenya", None, 9), (None, None, 9), ("Nairobi", "Cook - Malindi", 2),
    ],
)
def test_zones(spark, location, title, expected):
    df = spark.createDataFrame([(location, title)], "l string, t string")
    assert df.select(places.zone_rank(F.col("l"), F.col("t"))).first()[0] == expected


FILLER = "copies of " + "all your relevant original " * 12_500


def test_long_runs_do_not_exhaust_the_stack(spark):
    texts = [
        FILLER + "certificates", FILLER + "nothing", "school leaving " * 50_000, "never pay for any " + "word " * 50_000,
        "certificate of good " * 50_000, "kcse mean grade " * 50_000, "or diploma " * 50_000,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = rows.select("id", F.length(qualification.strip_benign(F.col("t"))).alias("n")).orderBy("id").collect()
    assert out[0]["n"] == 1 and out[1]["n"] == len(FILLER + "nothing")
    df = rows.selectExpr(
        "id", "'Clerk' title", "t description", "cast(null as string) body", "cast(null as array<string>) qualifications",
        "cast(null as string) experience",
    )
    assert qualify.evaluate(df).select("ok").count() == len(qualify.evaluate(df).select("ok").collect()) == len(texts)
