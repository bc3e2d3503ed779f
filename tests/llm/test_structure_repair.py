"""Structure repair against a search over all cheapest edits."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from vacansift.llm import structure_repair as sr

VALID = re.compile(r"(s?(ua)+)?")


def searched(symbols):
    """Least (cost, letters) over paths, kept whole: for every row and every role sequence's automaton state the least pair."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    best = {"": (0, "")}

    def inserted(paths):
        for _ in range(3):
            for state, (cost, letters) in list(paths.items()):
                for role, to in step[state].items():
                    if role != "s":
                        paths[to] = min(paths.get(to, (10**9, "")), (cost + 2, letters + "I"))
        return paths

    best = inserted(best)
    for sym in symbols:
        new = {}
        for state, (cost, letters) in best.items():
            options = [(state, 3, "D")]
            if sym:
                initial, cut = "sua?"[(sym - 1) // 2], (sym - 1) % 2
                for role, to in step[state].items():
                    if role == initial:
                        options.append((to, cut, "K"))
                    if role != "s":
                        options.append((to, 2 + cut, "R"))
            for to, more, letter in options:
                new[to] = min(new.get(to, (10**9, "")), (cost + more, letters + letter))
        best = inserted(new)
    return min(best[q] for q in ("", "ua") if q in best)


def roles(symbols, edits):
    out = []
    for k, edit in enumerate(edits):
        out += [c for c in edit if c in "ua"]
        if k < len(symbols) and edit[-1] != "D":
            out.append("sua?"[(symbols[k] - 1) // 2] if edit[-1] == "K" else edit[-1].lower())
    return "".join(out)


def test_all_short_sequences():
    for n in range(5):
        for symbols in itertools.product(range(9), repeat=n):
            cost, edits = sr.repaired(bytes(symbols))
            assert (cost, sr.audit(edits)) == searched(symbols), symbols
            assert VALID.fullmatch(roles(symbols, edits))


def test_long_sequences_and_table_size():
    rng = random.Random(2)
    for n in (5, 7, 8, 9, 31, 200, 3001):
        for weights in ([1] * 9, [9, 1, 1, 1, 1, 1, 1, 1, 1], [1, 9, 1, 1, 1, 1, 1, 9, 9], [0, 0, 0, 5, 1, 5, 1, 0, 0]):
            symbols = bytes(rng.choices(range(9), weights, k=n))
            cost, edits = sr.repaired(symbols)
            assert (cost, sr.audit(edits)) == searched(symbols)
            assert len(edits) == n + 1 and VALID.fullmatch(roles(symbols, edits))
    assert len(sr._tables().vectors) < 200


def plainly(rows):
    """The whole result for one conversation, row by row."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, symbols, faults = set(), [], []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        place = "sua".find(role[:1]) if role else -1
        symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * (3 if place < 0 else place) + (fault == "truncated"))
    cost, letters = searched(symbols)
    out, k = [], 0
    for letter in letters:
        ua = "assistant" if out and out[-1].startswith("u") else "user"
        if letter == "I":
            out.append(f"{ua}:")
            continue
        if letter != "D":
            out.append(f"{rows[k][1] if letter == 'K' else ua}:{rows[k][2]}")
        k += 1
    numbers = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": letters,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    texts = ["Yes.", "No", " ", "", None, "Really?\n", "a\n.", "Ünd!", "same text", "x" * 5000, "end.\n\n"]
    names = ["user", "assistant", "system", "tool", None, "", "unknown", "aide", "Ärger"]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([None, *range(-2, 9)]), rng.choice(names), rng.choice(texts), "z"))
    rows += [(99, k, "user", "hot.", "z") for k in range(3000)]
    return rows


def test_repair_equals_plain_work(spark, made):
    schema = "conv_id long, turn long, role string, text string, pos string"
    df = spark.createDataFrame(made, schema).withColumns({"cost": F.lit("x"), "same_id": F.lit(1)})
    found = {r["conv_id"]: r.asDict() for r in sr.repair(df, spark.range(200, 202).toDF("conv_id")).collect()}
    convs = {}
    for conv, turn, role, text, _ in made:
        convs.setdefault(conv, []).append((turn, role, text))
    assert set(found) == {*convs, 200, 201}
    for conv, rows in convs.items():
        assert found[conv] == {"conv_id": conv, **plainly(rows)}
    empty = hashlib.sha256().hexdigest()
    assert found[200] == {"conv_id": 200, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": empty}


def test_empty_table(spark, made):
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, pos string").limit(0)
    assert sr.repair(df).collect() == []
