"""Markup helpers, detail pages and board rules on small pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacansift.functions import dates, markup, text
from vacansift.operators import qualify
from vacansift.sources import boards, details, feed

DAY = dt.date(2026, 9, 10)


def value(spark, expression, *inputs):
    names = [f"c{i}" for i in range(len(inputs))]
    df = spark.createDataFrame([inputs], ", ".join(f"{n} string" for n in names))
    return df.select(expression(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<b>b</b></p>", "a b"),
        ("a&amp;lt;b &lt;&#65;&#x1F393;&eacute;&nbsp;&unknown; x & y", "a&lt;b <A🎓é &unknown; x & y"),
        ("<!DOCTYPE html><script>var t='</p>';</script><style>p{}</style>x<!-- c -->y", "xy"),
        ("  one\n\n two\t</p>three", "one two three"),
        ("&#0;&#xD800;&#1114112;", "&#0;&#xD800;&#1114112;"),
    ],
)
def test_block_text(spark, html, expected):
    assert value(spark, markup.block_text, html) == expected


def test_normalize(spark):
    assert value(spark, text.normalize_text, " A B \x1c c\n D ") == "a b c d"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Application deadline: 30th July 2026", dt.date(2026, 7, 30)),
        ("closing date 31/08/2026", dt.date(2026, 8, 31)),
        ("apply by september 25, 2026.", dt.date(2026, 9, 25)),
        ("Deadline 23rd February, 2026", dt.date(2026, 2, 23)),
        ("Deadline: 31 February 2026 or 01-03-2026", dt.date(2026, 3, 1)),
        ("Deadline: later. Long text that goes on and on until 3 May 2026", None),
        ("posted 3 May 2026", None),
    ],
)
def test_deadline(spark, given, expected):
    assert value(spark, dates.extract_deadline, given) == expected


def test_posted_dates(spark):
    day_month = lambda c: dates.posted_day_month(c, DAY)
    assert value(spark, day_month, "28 August") == dt.date(2026, 8, 28)
    assert value(spark, day_month, "28 December") == dt.date(2025, 12, 28)
    assert value(spark, day_month, "29 February") is None
    assert value(spark, day_month, "28 august") is None
    relative = lambda c: dates.posted_relative(c, DAY)
    assert value(spark, relative, "posted 2 Weeks ago") == dt.date(2026, 8, 27)
    assert value(spark, relative, "Yesterday 3 days ago") == dt.date(2026, 9, 9)
    assert value(spark, relative, "ages ago") is None
    glued = "September 9, 2026September 9, 2026"
    assert value(spark, dates.posted_month_day_year, glued) is None
    assert value(spark, lambda c: dates.posted_month_day_year(c, False), glued) == dt.date(2026, 9, 9)
    assert value(spark, dates.posted_from_iso, "2026-08-01T23:30:00-05:00") == dt.date(2026, 8, 1)
    assert value(spark, dates.posted_from_iso, "01/08/2026") is None


DETAIL = """
<html><body><header>All jobs: Diploma, Degree, Vocational</header>
<section><p>Posted: Nov 3, 2026 <em>(new)</em></p><h1>Night Guard, Harbour Depot</h1>
<ul><li>Job Type <a>Contract</a></li>
<li>Qualification <a>KCSE</a> , <a>Vocational</a></li>
<li>Experience 2 years</li><li>Location <a>Kilifi</a></li><li>Job Field <a>Security</a></li></ul>
<ol><li>Walks the fence twice an hour.</li><li>Writes the log book &amp; counts keys.</li></ol>
<p>Calm under pressure.</p>
<h2>Method of Application</h2><p>Bring a degree of patience to gate four.</p></section>
<footer>Diploma jobs</footer></body></html>
"""


def test_detail_page(spark):
    pages = spark.createDataFrame(
        [("guard", DETAIL), ("bare", "<html><body><p>gone</p></body></html>"), ("none", None)],
        "source_url string, html string",
    )
    parsed = details.parse(pages)
    row = {r.source_url: r for r in parsed.collect()}
    guard = row["guard"]
    assert guard["qualifications"] == ["KCSE", "Vocational"]
    assert guard["experience"].startswith("2 years")
    for inside in ("fence twice", "log book & counts", "Calm"):
        assert inside in guard["body"]
    for outside in ("gate four", "footer", "All jobs", "Degree"):
        assert outside not in guard["body"]
    for name in ("bare", "none"):
        assert tuple(row[name])[1:] == ("", [], "")
    job = spark.createDataFrame([("guard", "Night Guard", "watch")], "source_url string, title string, description string")
    verdict = qualify.evaluate(qualify.with_details(job, parsed)).first()
    assert verdict["ok"] and verdict["level"] == "confirmed"
    assert verdict["verdict_reasons"][-1] == "Experience: 2 years"


def test_untitled_links_hide_or_yield(spark):
    """Most rules drop a URL whose first link has no text; one takes the next link."""
    heading = '<div><h3><a href="/x/jobs/1"></a></h3></div><div><h3><a href="/x/jobs/1">Cook</a></h3></div>'
    link = '<a href="/listings/1"></a><a href="/listings/1">Cook</a><p>Easy apply</p>'
    pages = spark.createDataFrame([(1, heading, link)], "page_id int, h string, l string")
    assert boards.fuzu(pages.select("page_id", F.col("h").alias("html")), DAY).isEmpty()
    found = boards.brightermonday(pages.select("page_id", F.col("l").alias("html")), DAY).collect()
    assert [(r.title, r.source_url) for r in found] == [
        ("Cook", "https://www.brightermonday.co.ke/listings/1")
    ]


def test_pages_without_listings(spark):
    pages = spark.createDataFrame(
        [(1, "<p>Sorry, no vacancies</p>"), (2, None), (3, "")], "page_id int, html string"
    )
    for rule in boards.RULES.values():
        assert rule(pages, DAY).isEmpty()


def test_psc_longest_cell(spark):
    html = (
        "<table><tr><td>1</td><td>Deadline: 31/08/2026 and more words here</td><td>Clerk</td>"
        '<td>Cooks</td><td><a href="AdvertDetailsExt.aspx?k=1">View</a></td></tr></table>'
    )
    row = boards.psc(spark.createDataFrame([(1, html)], "page_id int, html string"), DAY).first()
    assert row["title"] == "Clerk" and row["deadline_date"] == dt.date(2026, 8, 31)
    assert row["source_url"] == "https://www.psckjobs.go.ke/AdvertDetailsExt.aspx?k=1"


def test_feed_entries(spark):
    entries = spark.createDataFrame(
        [
            ('{"fields": {"title": "ICT Officer", "url_alias": "u1", "date": {"created": '
             '"2026-08-01T01:00:00+03:00"}, "body": "<p>A&amp;B</p> Apply by 3 May 2026", '
             '"source": [{"name": "X"}, {"name": "Y"}]}}',),
            ('{"fields": {"title": " ", "url_alias": "u2"}}',),
            ('{"fields": {"title": "T"}}',),
            ("not json",),
        ],
        "entry string",
    )
    rows = feed.to_listings(feed.read_entries(entries)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.company, row.location, row.description) == ("X, Y", "Worldwide Remote", "a&b apply by 3 may 2026")
    assert (row.posted_date, row.deadline_date) == (dt.date(2026, 8, 1), dt.date(2026, 5, 3))
    assert feed.newest(feed.read_entries(entries)).count() == 1


def test_a_place_after_many_links(spark):
    others = "".join(f'<a href="/company/{i}">Team {i}</a>' for i in range(9))
    html = (
        '<div><h3><a href="/x/jobs/1">Cook</a></h3>' + others
        + '<a href="/job/nakuru">Nakuru</a></div><div><h3><a href="/x/jobs/2">Driver</a></h3><a href="/job/kisumu">Kisumu</a></div>'
    )
    rows = boards.fuzu(spark.createDataFrame([(1, html)], "page_id int, html string"), DAY).collect()
    assert sorted((r.title, r.location) for r in rows) == [("Cook", "Nakuru"), ("Driver", "Kisumu")]


def test_pages_without_a_rule_are_counted(spark):
    pages = spark.createDataFrame([("PSC",), ("Elsewhere",), ("Elsewhere",), (None,)], "board string")
    counts = {r["board"]: r["pages"] for r in boards.unruled(pages).collect()}
    assert counts == {"Elsewhere": 2, None: 1}


def test_very_long_cells_and_pages(spark):
    cell = "<td>" + "word " * 50_000 + "</td>"
    html = f'<table><tr>{cell}<td><a href="AdvertDetailsExt.aspx?k=9">Guard</a></td></tr></table>'
    for rule in boards.RULES.values():
        rule(spark.createDataFrame([(1, html)], "page_id int, html string"), DAY).collect()
    row = boards.psc(spark.createDataFrame([(1, html)], "page_id int, html string"), DAY).first()
    assert row["title"] == "Guard" and len(row["description"]) > 200_000


def outlined(spark, html, opening="<h2", names=("li", "div")):
    """Markup of the nearest containers around each anchor, per name."""
    from vacansift.functions import containers

    df = spark.createDataFrame([(" " + html,)], "html string").withColumn("parts", containers.pieces(F.col("html"), opening))
    df = df.withColumn("o", containers.outline(F.col("parts"), opening))

    def around(name):
        first = lambda i: F.get(containers.around(F.col("o"), i, [name]), F.lit(0))
        return F.transform(F.sequence(F.lit(1), F.size("o.anchors")), lambda i: containers.content(F.col("parts"), F.col("o"), first(i)))

    return [list(v) for v in df.select(*[around(n) for n in names]).first()]


@pytest.mark.parametrize(
    "html, items, divs",
    [
        ("<li>a<h2>t</h2>b</li>c", ["<li>a<h2>t</h2>b"], [None]),
        ("<div>a<div>b</div><h2>t</h2><div>c</div>d</div>e", [None], ["<div>a<div>b</div><h2>t</h2><div>c</div>d"]),
        ("<ul><li>a<h2>t</h2><li>b<h2>u</h2></ul>c", ["<li>a<h2>t</h2>", "<li>b<h2>u</h2>"], [None, None]),
        ("<li><h2>t</h2><ul><li>x<li>y</ul>z</li>", ["<li><h2>t</h2><ul><li>x<li>y</ul>z"], [None]),
        ("</div></li><DIV id='a'><h2>t</h2></li>u", [None], ["<DIV id='a'><h2>t</h2></li>u"]),
        ("<div><li><h2>t</h2>a</div>b<h2>u</h2>", ["<li><h2>t</h2>a", None], ["<div><li><h2>t</h2>a", None]),
        ("<h2>t</h2>", [None], [None]),
        ("<div>" * 40 + "<h2>t</h2>" + "</div>" * 40, [None], ["<div><h2>t</h2>"]),
    ],
)
def test_containers_of_anchors(spark, html, items, divs):
    assert outlined(spark, html) == [items, divs]


def test_table_cells_end_where_the_next_one_starts(spark):
    html = "<table><tr><td>a<h2>t</h2><td>b<table><tr><td>n</table><h2>u</h2><tr><td>c</table>"
    cells, rows = outlined(spark, html, names=("td", "tr"))
    assert cells == ["<td>a<h2>t</h2>", "<td>b<table><tr><td>n</table><h2>u</h2>"]
    assert rows == ["<tr><td>a<h2>t</h2><td>b<table><tr><td>n</table><h2>u</h2>"] * 2


def test_cards_climb_to_the_element_with_the_date(spark):
    card = '<div><div><a href="/listings/{0}">Clerk {0}</a></div><p>Firm {0}</p><p>Nairobi</p><div>{1}</div></div>'
    html = "<div>" + card.format(1, "3 days ago") + card.format(2, "") + card.format(3, "Easy apply") + "</div>"
    rows = boards.brightermonday(spark.createDataFrame([(1, html)], "page_id int, html string"), DAY)
    found = {r["source_url"][-1]: (r["title"], r["company"], r["posted_date"]) for r in rows.collect()}
    # A card without date or label takes the first element above that has one, here the whole list.
    assert found["1"] == ("Clerk 1", "Firm 1", DAY - dt.timedelta(days=3))
    assert found["3"] == ("Clerk 3", "Firm 3", None)
    assert found["2"][0] == "Clerk 2" and found["2"][2] == DAY - dt.timedelta(days=3)
