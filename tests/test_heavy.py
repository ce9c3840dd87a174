"""Pairs, trends and lists against brute force on small data."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from casetide.plans import heavy, reports, shares


def tables(spark, drug_rows, outcomes, reactions=()):
    return {
        "drug": spark.createDataFrame(
            drug_rows,
            "report_id long, drug_seq int, role_cod string, drugname_clean string, quarter string",
        ),
        "outc": spark.createDataFrame(outcomes, "report_id long, outc_cod string"),
        "reac": spark.createDataFrame(
            list(reactions) or [(-1, "x")], "report_id long, pt_clean string"
        ),
    }


@pytest.fixture(scope="module")
def data():
    pick = random.Random(11)
    rows = []
    for report in range(60):
        # Report 0 holds a third of all rows, most of its drugs named nowhere else.
        count = 150 if report == 0 else pick.randrange(1, 8)
        for seq in range(count):
            name = f"ONLY{seq}" if report == 0 and seq > 20 else f"D{pick.randrange(12)}"
            if pick.random() < 0.03:
                name = ""
            role = pick.choice(["PS", "SS", "C", "I"])
            rows.append((report, pick.choice([seq, seq // 2]), role, name, "2024q1"))
    outcomes = [(r, pick.choice(["DE", "HO", "OT", "LT"])) for r in range(60) for _ in range(r % 3)]
    return rows, outcomes


def names_by_report(rows):
    found = defaultdict(list)
    for report, seq, role, name, _ in rows:
        found[report].append((seq, role, name))
    return found


@pytest.mark.parametrize("rows_per_task", [10, 500_000])
@pytest.mark.parametrize("least", [2, 5])
def test_serious_pairs(spark, data, rows_per_task, least):
    rows, outcomes = data
    serious = {r for r, o in outcomes if o in ("DE", "LT", "HO")}
    counts = Counter()
    for report, entries in names_by_report(rows).items():
        names = [n for _, role, n in entries if role in ("PS", "SS") and n]
        if report in serious:
            counts.update((a, b) for a, b in itertools.product(names, names) if a < b)
    wanted = sorted(((a, b, c) for (a, b), c in counts.items() if c >= least),
                    key=lambda r: (-r[2], r[0], r[1]))[:500]
    found = heavy.drug_pairs_serious(tables(spark, rows, outcomes), least, rows_per_task=rows_per_task)
    assert [tuple(r) for r in found.collect()] == wanted


@pytest.mark.parametrize("rows_per_task", [10, 500_000])
@pytest.mark.parametrize("limit", [5, 20, 5000])
def test_ordered_pairs(spark, data, rows_per_task, limit, monkeypatch):
    monkeypatch.setattr(heavy, "BOUND_DRUGS", 4)
    rows, outcomes = data
    counts = Counter()
    for entries in names_by_report(rows).values():
        entries = [(s, n) for s, _, n in entries if n]
        counts.update({(n1, n2) for (s1, n1), (s2, n2) in itertools.product(entries, entries) if s1 < s2})
    wanted = sorted(((a, b, c) for (a, b), c in counts.items()), key=lambda r: (-r[2], r[0], r[1]))
    t = tables(spark, rows, outcomes)
    if limit == 5000:
        named = t["drug"].filter("drugname_clean <> ''")
        for least in (1, 4):
            found = heavy.place_pairs(named, least, rows_per_task=rows_per_task)
            enough = {k: n for k, n in counts.items() if n >= least}
            assert {(r.drug_1, r.drug_2): r.co_occurrence_reports for r in found.collect()} == enough
    else:
        found = heavy.drug_pairs(t, limit, rows_per_task)
        assert [tuple(r) for r in found.collect()] == wanted[:limit]


def test_polypharmacy(spark, data):
    rows, outcomes = data
    found = heavy.polypharmacy(tables(spark, rows, outcomes), 5, 3).collect()
    by_report = names_by_report(rows)
    order = sorted(by_report, key=lambda r: (-len(by_report[r]), r))[:3]
    assert [r.report_id for r in found] == order
    for r in found:
        entries = sorted((s, n) for s, _, n in by_report[r.report_id])
        assert r.drug_count == len(entries)
        assert r.drug_list == " | ".join(n for _, n in entries)


def test_trend_of_a_drug(spark, rows):
    t = tables(
        spark,
        [(1, 1, "PS", "RED RING", "2024q1"), (1, 2, "PS", "RED RING", "2024q1"),
         (2, 1, "PS", "BLUE RING", "2024q2"), (3, 1, "SS", "RING", "2024q2"),
         (4, 1, "PS", "GEAR", "2024q2"), (5, 1, "PS", "RING", "2024q3")],
        [(1, "DE"), (1, "DE"), (1, "HO"), (2, "HO"), (4, "DE")],
        [(1, "Rash"), (1, "Rash"), (1, "Itch"), (2, "Rash"), (4, "Pain")],
    )
    assert rows(heavy.drug_trend(t, "ring")) == [
        ("2024q1", 1, 1, 1, 2), ("2024q2", 1, 0, 1, 1), ("2024q3", 1, 0, 0, 0)
    ]


def test_wildcards_and_literals_in_drug_names(spark):
    view = spark.createDataFrame(
        [("RED RING", "Rash", "PS", "2024q1", 3), ("O'RING", "Rash", "PS", "2024q2", 2),
         ("GEAR", "Itch", "PS", "2024q1", 9)],
        "drugname_clean string, reaction_term string, role_cod string, quarter string, "
        "report_count long",
    )
    v = {"mv_drug_reaction_pairs": view}
    assert [tuple(r) for r in reports.drug_reactions(v, "ring").collect()] == [
        ("Rash", 5, "2024q1, 2024q2")
    ]
    assert reports.drug_reactions(v, "o'ring' OR 1=1 --").count() == 0
    assert reports.drug_reactions(v, "r_d%g").collect()[0].report_count == 3


def test_shares(spark):
    counted = spark.createDataFrame([("A", 8), ("B", 2)], "drug string, death_reports long")
    found = shares.share_of_max(counted, "death_reports").collect()
    assert [r.share_of_max for r in found] == [100.0, 25.0]
    countries = spark.createDataFrame([("X", 8, 1), ("Y", 0, 0)], "c string, report_count long, death_count long")
    assert [r.death_pct for r in shares.country_death_pct(countries).collect()] == [12.5, 0.0]
