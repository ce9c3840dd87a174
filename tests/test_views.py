"""Hand-worked signals, invariants, and hot reports in the standing views."""

from collections import ChainMap

import pytest
from pyspark.sql import functions as F

from casetide.operators import cleaning
from casetide.plans import heavy, views
from casetide.sources.mapped import bed

SF = "/root/testdata/sf0.001"


def small_tables(spark, drugs, reactions, outcomes=(), people=()):
    ids = sorted({r for r, *_ in [*drugs, *reactions, *outcomes]})
    known = {p[0]: p for p in people}
    demo = [known.get(i, (i, "Unknown", None, "US", "MD")) for i in ids]
    return {
        "demo": spark.createDataFrame(
            [(i, i, 1, "2024q1", s, a, None, "Unknown", c, o) for i, s, a, c, o in demo],
            "report_id long, caseid long, caseversion int, quarter string, sex string, "
            "age_years double, weight_kg double, age_group string, reporter_country string, "
            "occp_cod string",
        ),
        "drug": spark.createDataFrame(
            [(r, r, s, "2024q1", role, role, n, "I") for r, s, role, n in drugs],
            "report_id long, caseid long, drug_seq int, quarter string, role_cod string, "
            "drug_role string, drugname_clean string, prod_ai_clean string",
        ),
        "reac": spark.createDataFrame(
            [(r, "2024q1", p) for r, p in reactions],
            "report_id long, quarter string, pt_clean string",
        ),
        "outc": spark.createDataFrame(
            [(r, "2024q1", o, o) for r, o in outcomes] or [(-1, "2024q1", "OT", "OT")],
            "report_id long, quarter string, outc_cod string, outcome_label string",
        ),
    }


@pytest.fixture(scope="module")
def signal_tables(spark):
    drugs, reactions = [], []
    # A with Rash: 4 of A's 8 reports; Rash: 10 reports; all: 40. PRR (4/8)/(10/40) = 2.
    # B with Itch: all 3 reports of both, so the odds ratio has no denominator.
    # C with Rash: only 2 reports, below the minimum.
    for i in range(1, 41):
        name = "A" if i <= 8 else "B" if i <= 11 else "C" if i <= 20 else "D"
        drugs += [(i, 1, "PS", name), (i, 2, "C", "Z"), (i, 3, "PS", "")]
        rash = i <= 4 or i in (12, 13) or 21 <= i <= 24
        reactions += [(i, "Rash")] * 2 if rash else []
        reactions += [(i, "Itch")] if 9 <= i <= 11 else []
        reactions += [(i, "Nausea")]
    return small_tables(spark, drugs, reactions)


@pytest.mark.parametrize("rows_per_task", [1, 500_000])
def test_signal_counts_by_hand(signal_tables, rows_per_task):
    found = {
        (r.drugname_clean, r.reaction_term): r
        for r in views.mv_signal_prr(signal_tables, rows_per_task).collect()
    }
    rash = found["A", "Rash"]
    assert (
        rash.drug_reaction_count, rash.drug_total, rash.reaction_total, rash.grand_total
    ) == (4, 8, 10, 40)
    assert (rash.prr, rash.ror, rash.is_signal) == (2.0, round(4 * 26 / (4 * 6), 3), True)
    itch = found["B", "Itch"]
    assert (itch.prr, itch.ror, itch.is_signal) == (round(1 / (3 / 40), 3), None, True)
    nausea = found["A", "Nausea"]
    assert (nausea.prr, nausea.ror, nausea.is_signal) == (1.0, None, False)
    assert ("C", "Rash") not in found
    assert not any(drug in ("", "Z") for drug, _ in found)


def test_full_recalculation_agrees_on_one_quarter(signal_tables):
    view = views.mv_signal_prr(signal_tables).collect()
    full = heavy.prr_full(signal_tables).collect()
    assert {(r.drugname_clean, r.reaction_term, r.prr, r.ror) for r in view} == {
        (r.drug, r.reaction, r.prr, r.ror) for r in full
    }


@pytest.fixture(scope="module")
def mapped(spark):
    return bed(spark, SF).tables()


@pytest.mark.parametrize(
    "build", [views.mv_drug_reaction_pairs, views.mv_drug_outcomes, views.mv_signal_prr]
)
def test_hot_reports_change_nothing(mapped, rows, build):
    assert rows(build(mapped, rows_per_task=3)) == rows(build(mapped))


def test_hot_reports_change_no_ratio(mapped, rows):
    for least in (1, 4):
        cut = heavy.prr_full(mapped, least, rows_per_task=3)
        assert rows(cut) == rows(heavy.prr_full(mapped, least))


def test_case_in_several_roles_counts_once(spark, rows):
    t = small_tables(
        spark,
        [(1, 1, "PS", "A"), (1, 2, "SS", "A"), (1, 3, "PS", "A"), (2, 1, "C", "A")],
        [(1, "Rash"), (2, "Rash")],
    )
    assert rows(views.mv_top_drugs(t)) == [("A", "I", "2024q1", 2, 1, 1, 1)]


def test_mean_age_weighs_by_outcomes(spark):
    t = small_tables(
        spark,
        [(1, 1, "PS", "A"), (2, 1, "PS", "A"), (3, 1, "PS", "A")],
        [(1, "Rash")],
        [(1, "DE"), (1, "HO"), (1, "OT"), (2, "DE")],
        [(1, "Male", 20.0, "US", "MD"), (2, "Female", 60.0, "FR", "CN"), (3, "Male", 40.0, None, "MD")],
    )
    row = views.mv_quarterly_trends(t).collect()[0]
    assert (row.total_cases, row.deaths, row.hospitalizations) == (3, 2, 1)
    assert row.avg_age == (3 * 20 + 60 + 40) / 5
    assert row.reporting_countries == 2
    # The drug's own mean and median are over drug rows.
    t["drug"] = t["drug"].union(t["drug"].filter(F.col("report_id") == 1))
    male = views.mv_age_sex_distribution(t).filter("sex = 'Male'").collect()[0]
    assert (male.report_count, male.avg_age, male.median_age) == (2, 80 / 3, 20.0)


def test_signal_invariants(mapped):
    signals = views.mv_signal_prr(mapped)
    assert signals.filter("drug_reaction_count > least(drug_total, reaction_total)").count() == 0
    assert signals.filter("reaction_total > grand_total").count() == 0


def test_views_agree_with_the_tables(mapped):
    latest = views.mv_latest_cases(mapped)
    reports = mapped["reac"].join(latest.select("report_id"), "report_id", "left_semi")
    wanted = reports.select("report_id", "pt_clean", "quarter").distinct().count()
    assert views.mv_top_reactions(mapped).agg(F.sum("report_count")).collect()[0][0] == wanted
    cases_ = views.mv_quarterly_trends(mapped).agg(F.sum("total_cases")).collect()[0][0]
    assert cases_ == latest.count()


def test_refresh_stores_all_views(spark, mapped, tmp_path, rows):
    stored = views.refresh_views(spark, mapped, str(tmp_path), ["mv_top_drugs", "mv_top_reactions"])
    assert set(stored) == {"mv_latest_cases", "mv_top_drugs", "mv_top_reactions"}
    assert rows(stored["mv_top_drugs"]) == rows(views.mv_top_drugs(mapped))
    views.register_views(stored)
    assert spark.sql("SELECT count(*) FROM mv_top_reactions").collect()[0][0] > 0


def test_known_hot_reports_change_nothing(mapped, rows):
    hot = views.hot_reports(mapped, 6)
    assert hot.count() > 0
    known = ChainMap({"hot_reports": hot}, mapped)
    for name in ("mv_top_drugs", "mv_top_reactions", "mv_death_by_drug"):
        assert rows(views.VIEWS[name](known)) == rows(views.VIEWS[name](mapped))
    for build in (views.mv_signal_prr, views.mv_drug_outcomes):
        assert rows(build(known, rows_per_task=4)) == rows(build(mapped))


def test_no_view_plan_needs_a_cartesian_product(mapped):
    for name, build in views.VIEWS.items():
        plan = build(mapped)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_clean_tables_have_their_layout(mapped):
    for name in mapped:
        assert mapped[name].columns == cleaning.S.CLEAN[name].names
