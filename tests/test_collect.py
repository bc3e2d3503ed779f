"""Collection operators against plain Python simulations."""

import random

from vacansift.operators import collect


def crawl_rows(seed, boards, categories, pages, per_page, urls):
    rng = random.Random(seed)
    rows = []
    for b in boards:
        for c in range(categories):
            for p in range(1, pages + 1):
                if rng.random() < 0.1:
                    continue  # an empty page
                narrow = urls if rng.random() < 0.6 else 3
                for pos in range(per_page):
                    rows.append((b, f"u{rng.randrange(narrow)}", c, p, pos))
    return rows


def simulate(rows, boards, categories, pages):
    kept = set()
    for b in boards:
        seen = set()
        for c in range(categories):
            for p in range(1, pages + 1):
                fresh = 0
                for _, url, *_ in sorted(
                    (r for r in rows if r[0] == b and r[2] == c and r[3] == p), key=lambda r: r[4]
                ):
                    if url not in seen:
                        seen.add(url)
                        kept.add((b, url, c, p))
                        fresh += 1
                if fresh == 0:
                    break
    return kept


def test_paging_stop(spark):
    boards = [f"b{i}" for i in range(12)]
    rows = crawl_rows(7, boards, 4, 3, 6, 40)
    df = spark.createDataFrame(
        rows, "source string, source_url string, category_ord int, page int, pos int"
    )
    found = collect.paged(df).select("source", "source_url", "category_ord", "page")
    got = {tuple(r) for r in found.collect()}
    assert got == simulate(rows, boards, 4, 3)


def test_paging_takes_any_board_and_page(spark):
    rows = [("a new board", f"u{p}", 17, p, 0) for p in range(1, 8)] + [("b", "late", 0, 2, 0)]
    df = spark.createDataFrame(rows, "source string, source_url string, category_ord int, page int, pos int")
    got = sorted((r.source, r.page) for r in collect.paged(df).collect())
    assert got == [("a new board", p) for p in range(1, 8)]  # page 1 of the other board shows nothing new


def test_first_seen_backfilled_with_a_hot_url(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(900):
        url = "hot" if seq % 3 == 0 else f"u{rng.randrange(200)}"
        rows.append(
            (url, f"t{seq}", rng.choice([None, "KENYA"]), rng.choice([None, "", "Contract"]), seq)
        )
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "source_url string, title string, eligibility string, employment_type string, seq int"
    )
    got = {
        r["source_url"]: tuple(r)
        for r in collect.first_seen_backfilled(
            df, ("seq",), ("eligibility", "employment_type")
        ).select("source_url", "title", "eligibility", "employment_type").collect()
    }
    want = {}
    for url, title, eligibility, kind, _ in sorted(rows, key=lambda r: r[-1]):
        if url not in want:
            want[url] = [url, title, eligibility, kind]
            continue
        row = want[url]
        row[2] = row[2] if row[2] is not None else eligibility
        row[3] = (row[3] or None) if (row[3] or None) is not None else kind
    # A field that only ever held '' reads as missing once a second row came.
    for row in want.values():
        copies = sum(1 for r in rows if r[0] == row[0])
        if copies > 1 and row[3] == "":
            row[3] = None
    assert got == {u: tuple(r) for u, r in want.items()}


def test_union_keeps_order_and_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", "FORM4")], "source_url string, category_hint string")
    b = spark.createDataFrame([("x",), ("y",)], "source_url string")
    rows = collect.with_category(collect.union_boards([a, b])).collect()
    assert sorted((r.board_ord, r.source_url, r.category) for r in rows) == [
        (0, "x", "FORM4"), (1, "x", "ICT"), (1, "y", "ICT"),
    ]


def test_first_seen_prefers_order(spark):
    df = spark.createDataFrame(
        [("s", "u", 2, "b"), ("s", "u", 1, "a"), ("t", "u", 9, "c")],
        "source string, source_url string, seq int, title string",
    )
    rows = collect.first_seen(df, ("source", "source_url"), ("seq",)).collect()
    assert sorted((r.source, r.title) for r in rows) == [("s", "a"), ("t", "c")]
