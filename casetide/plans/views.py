"""The ten standing views over the cleaned tables.

Each builder takes the tables by name and returns a DataFrame. With the large reports stored
beside the tables no base table is read to build a plan; without, their keys are. Reports are
counted once per case (``mv_latest_cases``). Distinct counts are written as a removal
of duplicates followed by a plain count: duplicates go within the partitioning the
join on ``report_id`` needs anyway, and the final count combines on the map side, so a
drug named in a third of all reports does not overload a task.

``report_id`` identifies a row of ``demo``. Stored views can be passed as tables under
their own names; a builder then reads them instead of building them again.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide.functions import ratios as R
from casetide.functions.clean import drug_role_label, nonempty, outcome_label
from casetide.operators import cases
from casetide.plans.skew import (
    HOT_REPORTS,
    LEFT_PART,
    RIGHT_PART,
    ROWS_PER_TASK,
    Grid,
    hot_keys,
    stored_keys,
)
from casetide.runtime import together

Tables = Mapping[str, DataFrame]


def _latest(t: Tables) -> DataFrame:
    return t["mv_latest_cases"] if "mv_latest_cases" in t else mv_latest_cases(t)


def hot_reports(t: Tables, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Reports with very many drug, reaction or outcome rows, found once for all views."""
    if HOT_REPORTS in t:
        return t[HOT_REPORTS]
    return hot_keys({n: t[n] for n in ("drug", "reac", "outc")}, ["report_id"], rows_per_task)


def _named(drug: DataFrame) -> DataFrame:
    return drug.filter(nonempty(F.col("drugname_clean")))


def per_report(
    rows: DataFrame,
    reports: DataFrame,
    columns: list[str],
    flags: Sequence[Column] = (),
    rows_per_task: int = ROWS_PER_TASK,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row for each report and distinct ``columns``, for the given reports only.

    ``reports`` has a row per report; its further columns are carried along. What is
    measured is the number of ``rows``, or ``flags`` that are maxima. One shuffle on
    ``report_id`` serves the restriction to the reports and the grouping. If there are
    large reports, equal rows are put together before the reports are cut.
    """
    grid = Grid(["report_id"], rows, rows_per_task=rows_per_task, known=known)
    by = ["report_id", *columns]
    carried = [c for c in reports.columns if c != "report_id"]
    measures = list(flags) or [F.count("*").alias("rows")]
    if grid.parts:
        rows = rows.groupBy(*by).agg(*measures)
        names = [c for c in rows.columns if c not in by]
        measures = [(F.max(n) if flags else F.sum(n)).alias(n) for n in names]
    kept = grid.left(rows, by).join(grid.copies(reports), grid.keys, "inner" if carried else "left_semi")
    return kept.groupBy(*grid.keys, *columns, *carried).agg(*measures).drop(*grid.parts)


class Pairing:
    """Distinct drug rows and distinct reaction rows, ready to meet on ``report_id``.

    Both sides are shuffled once, on ``report_id`` and the parts of hot reports. The
    restriction to the newest reports, the removal of duplicates, the join of both
    sides and the totals of either side all use that layout.
    """

    def __init__(
        self,
        drugs: DataFrame,
        others: DataFrame,
        latest: DataFrame | None,
        rows_per_task: int = ROWS_PER_TASK,
        known: DataFrame | None = None,
    ):
        self._rows_per_task = rows_per_task
        self._grid = Grid(["report_id"], drugs, others, rows_per_task, known)
        if self._grid.parts:
            # Equal rows of a large report would all go to one of its parts.
            drugs, others = drugs.dropDuplicates(), others.dropDuplicates()
        self._restricted = latest is not None
        self._all_drugs, self._all_others = drugs, others
        self._drugs, self._others = self._place_drugs(drugs), self._place_others(others)
        self._latest = None
        if latest is not None:
            self._latest = self._grid.copies(latest.select("report_id"))

    def _place_drugs(self, drugs: DataFrame) -> DataFrame:
        return self._grid.left(drugs, drugs.columns)

    def _place_others(self, others: DataFrame) -> DataFrame:
        return self._grid.right(others, others.columns)

    def _distinct(self, side: DataFrame) -> DataFrame:
        # Restricting either side brings it into the layout of the join, where the
        # removal of duplicates needs no shuffle of its own.
        if self._restricted:
            side = side.join(self._latest, self._grid.keys, "left_semi")
        else:
            side = side.repartition(*self._grid.keys)
        return side.dropDuplicates()

    def count(self, columns: list[str], name: str, least: int = 1) -> DataFrame:
        """Reports in which a drug row and another row meet, by their columns.

        Groups below ``least`` reports are left out. If there are hot reports, whose
        rows would all be paired, drugs and reactions that are too rare to reach
        ``least`` go before anything is paired; the result is the same without.
        """
        drugs, others = self._drugs, self._others
        if least > 1 and self._grid.parts:
            drugs = self._place_drugs(
                self._frequent(self._all_drugs, self.count_drugs, columns, least)
            )
            others = self._place_others(
                self._frequent(self._all_others, self.count_others, columns, least)
            )
        met = self._distinct(drugs).join(self._distinct(others), self._grid.keys)
        counted = met.groupBy(*columns).agg(F.count("*").alias(name))
        return counted.filter(F.col(name) >= least) if least > 1 else counted

    def _frequent(
        self, side: DataFrame, totals: Callable, columns: list[str], least: int
    ) -> DataFrame:
        own = [c for c in columns if c in side.columns]
        enough = totals(own, "_reports").filter(F.col("_reports") >= least).select(*own)
        return side.join(enough, own, "left_semi")

    def count_drugs(self, columns: list[str], name: str) -> DataFrame:
        # A drug row is copied to all parts of the other side and counts in the first.
        first = self._grid.first_copy(RIGHT_PART)
        return self._distinct(self._drugs).groupBy(*columns).agg(F.count_if(first).alias(name))

    def count_others(self, columns: list[str], name: str) -> DataFrame:
        first = self._grid.first_copy(LEFT_PART)
        return self._distinct(self._others).groupBy(*columns).agg(F.count_if(first).alias(name))


def _share(count: Column, whole: Column) -> Column:
    return count.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100


def _outcome_flags(outc: DataFrame) -> DataFrame:
    """One row per report: which outcomes it has, and how many outcome rows."""

    def has(code: str) -> Column:
        return F.max(F.when(F.col("outc_cod") == code, 1).otherwise(0))

    return outc.groupBy("report_id").agg(
        has("DE").alias("died"),
        has("HO").alias("hospitalized"),
        has("LT").alias("threatened"),
        F.count("*").alias("outcomes"),
    )


def _reports_with_flags(demo: DataFrame, t: Tables) -> DataFrame:
    """Newest reports with their outcome flags, null where a report has no outcome."""
    reports = demo.join(_latest(t).select("report_id"), "report_id", "left_semi")
    return reports.join(_outcome_flags(t["outc"]), "report_id", "left")


def mv_latest_cases(t: Tables) -> DataFrame:
    return cases.latest_cases(t["demo"])


def mv_drug_reaction_pairs(t: Tables, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    drugs = _named(t["drug"]).select(
        "report_id", "drugname_clean", "prod_ai_clean", "role_cod", "quarter"
    )
    reactions = (
        t["reac"]
        .filter(nonempty(F.col("pt_clean")))
        .select("report_id", F.col("pt_clean").alias("reaction_term"))
    )
    group = ["drugname_clean", "prod_ai_clean", "role_cod", "reaction_term", "quarter"]
    pairing = Pairing(drugs, reactions, _latest(t), rows_per_task, stored_keys(t, "drug", "reac"))
    # Labels follow from codes; they are added to the counts.
    return pairing.count(group, "report_count").withColumn(
        "drug_role", drug_role_label(F.col("role_cod"))
    )


def mv_drug_outcomes(t: Tables, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    drugs = _named(t["drug"]).select(
        "report_id", "drugname_clean", "prod_ai_clean", "role_cod", "quarter"
    )
    outcomes = t["outc"].select("report_id", "outc_cod")
    group = ["drugname_clean", "prod_ai_clean", "role_cod", "outc_cod", "quarter"]
    pairing = Pairing(drugs, outcomes, _latest(t), rows_per_task, stored_keys(t, "drug", "outc"))
    return pairing.count(group, "report_count").withColumn(
        "outcome_label", outcome_label(F.col("outc_cod"))
    )


def mv_death_by_drug(t: Tables) -> DataFrame:
    """Death reports of suspect drugs, and their share of all primary suspect reports.

    The numerator counts primary and secondary suspects, the denominator primary
    suspects of all quarters.
    """
    latest = _latest(t).select("report_id")
    deaths = t["outc"].filter(F.col("outc_cod") == "DE").select("report_id").distinct()
    suspects = _named(t["drug"]).filter(F.col("role_cod").isin("PS", "SS"))
    group = ["drugname_clean", "prod_ai_clean", "quarter"]
    dead = per_report(
        suspects.select("report_id", *group),
        latest.join(deaths, "report_id", "left_semi"),
        group,
        known=stored_keys(t, "drug"),
    )
    primary = t["drug"].filter(F.col("role_cod") == "PS").select("report_id").distinct()
    whole = latest.join(primary, "report_id", "left_semi").agg(F.count_distinct("report_id"))
    counts = dead.groupBy(*group).agg(F.count("*").alias("death_reports"))
    return counts.withColumn(
        "pct_of_all_ps_reports", _share(F.col("death_reports"), whole.scalar())
    )


def mv_reports_by_country(t: Tables) -> DataFrame:
    known = t["demo"].filter(F.col("reporter_country").isNotNull())
    return (
        _reports_with_flags(known, t)
        .groupBy("reporter_country", "quarter")
        .agg(
            F.count("*").alias("report_count"),
            F.count_if(F.col("died") == 1).alias("death_count"),
            F.count_if(F.col("hospitalized") == 1).alias("hospitalization_count"),
            F.count_if(F.col("threatened") == 1).alias("life_threatening_count"),
        )
    )


def with_ratios(
    pairs: DataFrame, a: str, n_drug: str, n_reac: str, total: str
) -> DataFrame:
    counts = [F.col(c) for c in (a, n_drug, n_reac, total)]
    return pairs.withColumns(
        {"prr": R.prr(*counts), "ror": R.ror(*counts), "is_signal": R.is_signal(*counts)}
    )


def mv_signal_prr(t: Tables, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Disproportionality of drug, reaction and quarter, for primary suspects.

    The pair and drug counts are those of the quarter, the reaction and grand totals
    those of all quarters.
    """
    latest = _latest(t)
    drugs = (
        _named(t["drug"])
        .filter(F.col("role_cod") == "PS")
        .select("report_id", "drugname_clean", "quarter")
    )
    reactions = t["reac"].select("report_id", F.col("pt_clean").alias("reaction_term"))
    pairing = Pairing(drugs, reactions, latest, rows_per_task, stored_keys(t, "drug", "reac"))
    pairs = pairing.count(
        ["drugname_clean", "reaction_term", "quarter"], "drug_reaction_count", R.SIGNAL_MIN_REPORTS
    )
    drug_totals = pairing.count_drugs(["drugname_clean", "quarter"], "drug_total")
    reaction_totals = pairing.count_others(["reaction_term"], "reaction_total")
    total = latest.agg(F.count_distinct("report_id"))
    counted = (
        pairs.join(drug_totals, ["drugname_clean", "quarter"])
        .join(reaction_totals, "reaction_term")
        .withColumn("grand_total", total.scalar())
        .select(
            "drugname_clean", "reaction_term", "quarter", "drug_reaction_count",
            "drug_total", "reaction_total", "grand_total",
        )
    )
    return with_ratios(
        counted, "drug_reaction_count", "drug_total", "reaction_total", "grand_total"
    )


def mv_age_sex_distribution(t: Tables) -> DataFrame:
    """Patients of each primary suspect drug. Means and median are over drug rows.

    A report that lists the drug twice weighs twice. The rows are counted per report
    first; the median then takes the counts as frequencies, and its buffer holds
    distinct ages only, whatever the number of reports.
    """
    primary = _named(t["drug"]).filter(F.col("role_cod") == "PS")
    people = t["demo"].select("report_id", "sex", "age_group", "age_years", "weight_kg")
    people = people.join(_latest(t).select("report_id"), "report_id", "left_semi")
    rows = F.col("rows")
    return (
        per_report(
            primary.select("report_id", "drugname_clean", "quarter"),
            people,
            ["drugname_clean", "quarter"],
            known=stored_keys(t, "drug"),
        )
        .groupBy("drugname_clean", "quarter", "sex", "age_group")
        .agg(
            F.count("*").alias("report_count"),
            R.mean_of_hundredths(F.col("age_years"), rows).alias("avg_age"),
            F.percentile("age_years", F.lit(0.5), rows).alias("median_age"),
            R.mean_of_hundredths(F.col("weight_kg"), rows).alias("avg_weight_kg"),
        )
    )


def mv_quarterly_trends(t: Tables) -> DataFrame:
    """Cases of each quarter. The mean age weighs a report by its outcome rows."""
    weight = F.greatest(F.coalesce(F.col("outcomes"), F.lit(1)), F.lit(1))
    return (
        _reports_with_flags(t["demo"], t)
        .groupBy("quarter")
        .agg(
            F.count("*").alias("total_cases"),
            F.count_if(F.col("died") == 1).alias("deaths"),
            F.count_if(F.col("hospitalized") == 1).alias("hospitalizations"),
            F.count_if(F.col("threatened") == 1).alias("life_threatening"),
            F.count_if(F.col("sex") == "Female").alias("female_cases"),
            F.count_if(F.col("sex") == "Male").alias("male_cases"),
            R.mean_of_hundredths(F.col("age_years"), weight).alias("avg_age"),
            F.count_distinct("reporter_country").alias("reporting_countries"),
        )
    )


def mv_top_drugs(t: Tables) -> DataFrame:
    """Reports of each drug, in all and by role.

    A report may list a drug in several roles, so roles are first gathered as flags
    of the report; a distinct count per role would copy every row four times.
    """
    group = ["drugname_clean", "prod_ai_clean", "quarter"]

    def has(role: str) -> Column:
        return F.max(F.when(F.col("role_cod") == role, 1).otherwise(0)).alias(role)

    roles = [has("PS"), has("SS"), has("C")]
    drugs = _named(t["drug"]).select("report_id", *group, "role_cod")
    latest = _latest(t).select("report_id")
    flags = per_report(drugs, latest, group, roles, known=stored_keys(t, "drug"))
    return flags.groupBy(*group).agg(
        F.count("*").alias("report_count"),
        F.sum("PS").alias("ps_count"),
        F.sum("SS").alias("ss_count"),
        F.sum("C").alias("concomitant_count"),
    )


def mv_top_reactions(t: Tables) -> DataFrame:
    reactions = t["reac"].filter(nonempty(F.col("pt_clean")))
    reactions = reactions.select("report_id", F.col("pt_clean").alias("reaction_term"), "quarter")
    return (
        per_report(
            reactions,
            _latest(t).select("report_id"),
            ["reaction_term", "quarter"],
            known=stored_keys(t, "reac"),
        )
        .groupBy("reaction_term", "quarter")
        .agg(F.count("*").alias("report_count"))
    )


# In order of dependency.
VIEWS: Mapping[str, Callable[[Tables], DataFrame]] = {
    "mv_latest_cases": mv_latest_cases,
    "mv_drug_reaction_pairs": mv_drug_reaction_pairs,
    "mv_drug_outcomes": mv_drug_outcomes,
    "mv_death_by_drug": mv_death_by_drug,
    "mv_reports_by_country": mv_reports_by_country,
    "mv_signal_prr": mv_signal_prr,
    "mv_age_sex_distribution": mv_age_sex_distribution,
    "mv_quarterly_trends": mv_quarterly_trends,
    "mv_top_drugs": mv_top_drugs,
    "mv_top_reactions": mv_top_reactions,
}


def build_views(t: Tables) -> dict[str, DataFrame]:
    """All views, lazily."""
    return {name: build(t) for name, build in VIEWS.items()}


def refresh_views(
    spark: SparkSession, t: Tables, root: str, names: list[str] | None = None
) -> dict[str, DataFrame]:
    """Rebuild and store the views, and return them as stored.

    ``mv_latest_cases`` and the list of hot reports are stored first and all others
    read them from there, so cases are resolved and keys are looked at once, and a
    lost executor costs no more than the views in progress. The others do not depend
    on each other and are built side by side.
    """
    root = root.rstrip("/")
    first = "mv_latest_cases"
    wanted = [n for n in names or VIEWS if n != first]

    def rebuild(name: str, build: Callable[[Tables], DataFrame], sources: Tables) -> None:
        build(sources).write.mode("overwrite").parquet(f"{root}/{name}")

    together([partial(rebuild, first, VIEWS[first], t), partial(rebuild, HOT_REPORTS, hot_reports, t)])
    shared = {n: spark.read.parquet(f"{root}/{n}") for n in (first, HOT_REPORTS)}
    sources = ChainMap(shared, t)
    together([partial(rebuild, name, VIEWS[name], sources) for name in wanted])
    return {n: spark.read.parquet(f"{root}/{n}") for n in (first, *wanted)}


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Make views available to SQL under their own names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
