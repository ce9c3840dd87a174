"""Standing views kept up to date by what changed, not by what there is.

Every view is a sum over the newest reports of their cases: each contributes its own rows to
counts. So a view is kept as *tallies*, tables of a group and its sums, from which the view
itself follows by a cheap last step (ratios, means, medians, shares). When the store moves to
another version, the reports whose contribution can differ are found from the quarters that
changed and from the cases they belong to; what they contributed in the former version is
taken away, what they contribute now is added. The same code builds contributions, tallies
from scratch, and both sides of a change, restricted to some reports.

Of the base tables only the quarters of those reports are read, in either version, and the
children stored apart from their report. Tallies and views are stored by quarter in versions
of their own; quarters without a change are carried over as they are, except in the two views
that depend on totals across quarters.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetide import schemas as S
from casetide.functions import ratios as R
from casetide.functions.clean import drug_role_label, nonempty, outcome_label
from casetide.plans import views as V
from casetide.runtime import materialize, release, together
from casetide.sources import snapshots, store
from casetide.sources.snapshots import Snapshot

Tables = Mapping[str, DataFrame]

LATEST = "mv_latest_cases"
#: Tallies that are built side by side: each needs disk for the shuffles of its joins.
TALLIES_AT_ONCE = 2
#: Partition of what belongs to no quarter.
NO_QUARTER = "all"
#: Note of a version of the views: the version of the store they show.
SHOWS = "store"
_DRUG = ["drugname_clean", "prod_ai_clean", "quarter"]


@dataclass(frozen=True)
class Tally:
    """Groups and their sums. ``by`` may hold ``quarter``; ``sums`` are whole numbers."""

    by: tuple[str, ...]
    sums: tuple[str, ...]
    build: Callable[[Tables], DataFrame]


def _latest_of(t: Tables) -> DataFrame:
    return t[LATEST].select("report_id")


def _hundredths(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def _pairs(t: Tables) -> DataFrame:
    return V.mv_drug_reaction_pairs(t).drop("drug_role")


def _outcomes(t: Tables) -> DataFrame:
    return V.mv_drug_outcomes(t).drop("outcome_label")


def _deaths(t: Tables) -> DataFrame:
    return V.mv_death_by_drug(t).drop("pct_of_all_ps_reports")


def _suspects(t: Tables) -> DataFrame:
    """Newest reports with a primary suspect, under whatever name."""
    primary = t["drug"].filter(F.col("role_cod") == "PS").select("report_id").distinct()
    return _latest_of(t).join(primary, "report_id", "left_semi").agg(F.count("*").alias("reports"))


def _pairing(t: Tables) -> V.Pairing:
    drugs = t["drug"].filter((F.col("role_cod") == "PS") & nonempty(F.col("drugname_clean"))).select("report_id", "drugname_clean", "quarter")
    reactions = t["reac"].select("report_id", F.col("pt_clean").alias("reaction_term"))
    return V.Pairing(drugs, reactions, t[LATEST], known=V.stored_keys(t, "drug", "reac"))


def _ages(t: Tables) -> DataFrame:
    """Reports and drug rows by drug and age, so that medians and means merge."""
    primary = t["drug"].filter((F.col("role_cod") == "PS") & nonempty(F.col("drugname_clean")))
    people = t["demo"].select("report_id", "sex", "age_group", "age_years", "weight_kg").join(_latest_of(t), "report_id", "left_semi")
    group = ["drugname_clean", "quarter"]
    rows = V.per_report(primary.select("report_id", *group), people, group, known=V.stored_keys(t, "drug"))
    weight = F.when(F.col("weight_kg").isNotNull(), F.col("rows"))
    return rows.groupBy(*group, "sex", "age_group", "age_years").agg(
        F.count("*").alias("reports"), F.sum("rows").alias("rows"),
        F.coalesce(F.sum(_hundredths(F.col("weight_kg")) * F.col("rows")), F.lit(0)).alias("weights"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("weighed"),
    )


def _people(t: Tables) -> DataFrame:
    """Cases by quarter and country of the reporter."""
    weight = F.greatest(F.coalesce(F.col("outcomes"), F.lit(1)), F.lit(1))
    rows = V._reports_with_flags(t["demo"], t)
    return rows.groupBy("quarter", "reporter_country").agg(
        F.count("*").alias("cases"),
        *[F.count_if(F.col(c) == 1).alias(c) for c in ("died", "hospitalized", "threatened")],
        F.count_if(F.col("sex") == "Female").alias("female"),
        F.count_if(F.col("sex") == "Male").alias("male"),
        F.coalesce(F.sum(_hundredths(F.col("age_years")) * weight), F.lit(0)).alias("ages"),
        F.coalesce(F.sum(F.when(F.col("age_years").isNotNull(), weight)), F.lit(0)).alias("aged"),
    )


TALLIES: Mapping[str, Tally] = {
    "pairs": Tally(("drugname_clean", "prod_ai_clean", "role_cod", "reaction_term", "quarter"), ("report_count",), _pairs),
    "outcomes": Tally(("drugname_clean", "prod_ai_clean", "role_cod", "outc_cod", "quarter"), ("report_count",), _outcomes),
    "deaths": Tally(tuple(_DRUG), ("death_reports",), _deaths),
    "suspects": Tally((), ("reports",), _suspects),
    "cases": Tally((), ("reports",), lambda t: _latest_of(t).agg(F.count("*").alias("reports"))),
    "signal_pairs": Tally(("drugname_clean", "reaction_term", "quarter"), ("reports",), lambda t: _pairing(t).count(["drugname_clean", "reaction_term", "quarter"], "reports")),
    "signal_drugs": Tally(("drugname_clean", "quarter"), ("reports",), lambda t: _pairing(t).count_drugs(["drugname_clean", "quarter"], "reports")),
    "signal_reactions": Tally(("reaction_term",), ("reports",), lambda t: _pairing(t).count_others(["reaction_term"], "reports")),
    "ages": Tally(("drugname_clean", "quarter", "sex", "age_group", "age_years"), ("reports", "rows", "weights", "weighed"), _ages),
    "people": Tally(("quarter", "reporter_country"), ("cases", "died", "hospitalized", "threatened", "female", "male", "ages", "aged"), _people),
    "drugs": Tally(tuple(_DRUG), ("report_count", "ps_count", "ss_count", "concomitant_count"), V.mv_top_drugs),
    "reactions": Tally(("reaction_term", "quarter"), ("report_count",), V.mv_top_reactions),
}


def _mean(total: str, count: str) -> Column:
    return F.col(total) / F.nullif(F.col(count) * 100, F.lit(0))


def exact_median(value: str, rows: str) -> Column:
    """Median of values given by their counts; the counts of several sets simply add up."""
    return F.percentile(value, F.lit(0.5), F.col(rows))


def _view_death(s: Tables) -> DataFrame:
    whole = s["suspects"].agg(F.sum("reports"))
    return s["deaths"].withColumn("pct_of_all_ps_reports", V._share(F.col("death_reports"), whole.scalar()))


def _view_country(s: Tables) -> DataFrame:
    named = {"report_count": "cases", "death_count": "died", "hospitalization_count": "hospitalized", "life_threatening_count": "threatened"}
    return s["people"].filter("reporter_country IS NOT NULL").select("reporter_country", "quarter", *[F.col(c).alias(n) for n, c in named.items()])


def _view_signal(s: Tables) -> DataFrame:
    pairs = s["signal_pairs"].filter(F.col("reports") >= R.SIGNAL_MIN_REPORTS).withColumnRenamed("reports", "drug_reaction_count")
    counted = (
        pairs.join(s["signal_drugs"].withColumnRenamed("reports", "drug_total"), ["drugname_clean", "quarter"])
        .join(s["signal_reactions"].withColumnRenamed("reports", "reaction_total"), "reaction_term")
        .withColumn("grand_total", s["cases"].agg(F.sum("reports")).scalar())
        .select("drugname_clean", "reaction_term", "quarter", "drug_reaction_count", "drug_total", "reaction_total", "grand_total")
    )
    return V.with_ratios(counted, "drug_reaction_count", "drug_total", "reaction_total", "grand_total")


def _view_ages(s: Tables) -> DataFrame:
    aged = F.when(F.col("age_years").isNotNull(), F.col("rows"))
    return (
        s["ages"].groupBy("drugname_clean", "quarter", "sex", "age_group")
        .agg(
            F.sum("reports").alias("report_count"),
            F.sum(_hundredths(F.col("age_years")) * F.col("rows")).alias("ages"), F.sum(aged).alias("aged"),
            exact_median("age_years", "rows").alias("median_age"),
            F.sum("weights").alias("weights"), F.sum("weighed").alias("weighed"),
        )
        .select("drugname_clean", "quarter", "sex", "age_group", "report_count", _mean("ages", "aged").alias("avg_age"), "median_age", _mean("weights", "weighed").alias("avg_weight_kg"))
    )


def _view_trends(s: Tables) -> DataFrame:
    named = {"total_cases": "cases", "deaths": "died", "hospitalizations": "hospitalized", "life_threatening": "threatened", "female_cases": "female", "male_cases": "male"}
    summed = s["people"].groupBy("quarter").agg(
        *[F.sum(c).alias(n) for n, c in named.items()],
        F.sum("ages").alias("ages"), F.sum("aged").alias("aged"),
        F.count("reporter_country").alias("reporting_countries"),
    )
    return summed.select("quarter", *named, _mean("ages", "aged").alias("avg_age"), "reporting_countries")


@dataclass(frozen=True)
class View:
    """A view over tallies. ``whole``: its rows depend on totals across quarters."""

    of: tuple[str, ...]
    finish: Callable[[Tables], DataFrame]
    whole: bool = False


VIEWS: Mapping[str, View] = {
    "mv_drug_reaction_pairs": View(("pairs",), lambda s: s["pairs"].withColumn("drug_role", drug_role_label(F.col("role_cod")))),
    "mv_drug_outcomes": View(("outcomes",), lambda s: s["outcomes"].withColumn("outcome_label", outcome_label(F.col("outc_cod")))),
    "mv_death_by_drug": View(("deaths", "suspects"), _view_death, whole=True),
    "mv_reports_by_country": View(("people",), _view_country),
    "mv_signal_prr": View(("signal_pairs", "signal_drugs", "signal_reactions", "cases"), _view_signal, whole=True),
    "mv_age_sex_distribution": View(("ages",), _view_ages),
    "mv_quarterly_trends": View(("people",), _view_trends),
    "mv_top_drugs": View(("drugs",), lambda s: s["drugs"]),
    "mv_top_reactions": View(("reactions",), lambda s: s["reactions"]),
}


def _tally_path(name: str) -> str:
    return f"tally_{name}"


def _quarters(df: DataFrame) -> set[str]:
    return {r.quarter for r in df.select("quarter").distinct().collect()}


class Upkeep:
    """Tallies and views below ``root`` for the store at ``store_root``."""

    def __init__(self, spark: SparkSession, store_root: str, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.held = snapshots.current(spark, root)
        self.after = snapshots.current(spark, store_root, version)
        self.shown = self.held.notes.get(SHOWS, {}).get("version")
        self.before = snapshots.current(spark, store_root, self.shown) if self.shown else None
        self.load = snapshots.new_load()
        self.hot = store.stored_tables(spark, store_root, version)[V.HOT_REPORTS]

    # -- reading and writing by quarter -------------------------------------

    def _write(self, name: str, df: DataFrame) -> None:
        if "quarter" not in df.columns:
            df = df.withColumn("quarter", F.lit(NO_QUARTER))
        path = snapshots.load_path(self.root, name, self.load)
        df.hint("rebalance", F.col("quarter")).write.partitionBy("quarter").parquet(path)
        release(self.spark)

    def _layout(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.held.notes["layouts"][name])

    def _stored(self, name: str, quarters: Iterable[str] | None = None) -> DataFrame:
        return self.held.read(self.spark, name, self._layout(name), quarters)

    def _fresh(self, name: str, layout: T.StructType, untouched: bool) -> DataFrame:
        """A table as it will be: what this load wrote of it, and what it carries over."""
        written = snapshots.written_quarters(self.spark, self.root, name, self.load)
        parts = dict.fromkeys(written, self.load)
        if untouched:
            replaced = self.replaced.get(name, set())
            parts = {q: v for q, v in self.held.parts.get(name, {}).items() if q not in replaced} | parts
        return Snapshot(self.root, 0, {name: parts}).read(self.spark, name, layout)

    # -- which reports changed ------------------------------------------------

    def _version(self, held: Snapshot, name: str, quarters: Iterable[str] | None) -> DataFrame:
        return store.read_version(self.spark, held, name, quarters)

    def _touched_ids(self) -> DataFrame:
        """Reports with a row, in either version, in a quarter that changed."""
        names = ("demo", "drug", "reac", "outc")
        changed = self.after.changed(self.before, names)
        found = [
            self._version(held, n, changed[n]).select("report_id")
            for n in names for held in (self.before, self.after) if changed[n] & held.quarters(n)
        ]
        if not found:
            return self.spark.createDataFrame([], "report_id long").limit(0)
        return reduce(DataFrame.union, found).distinct()

    def _newest(self) -> DataFrame:
        """The newest report of each case, from the former ones and the quarters that changed.

        Only if a newest report is gone its case is looked for in all quarters, in the two
        key columns of the reports.
        """
        changed = self.after.changed(self.before, ["demo"])["demo"]
        old = self._version(self.before, "demo", changed).select("report_id", "caseid")
        new = self._version(self.after, "demo", changed).select("report_id", "caseid")
        latest = self._stored(LATEST).select("caseid", "report_id")
        gone = materialize(latest.join(old.join(new, ["report_id", "caseid"], "left_anti"), ["report_id", "caseid"], "left_semi"), "gone-reports")
        stays = latest.join(gone, ["caseid", "report_id"], "left_anti")
        candidates = stays.select("caseid", "report_id").unionByName(new)
        if not gone.isEmpty():
            every = self._version(self.after, "demo", None).select("report_id", "caseid")
            candidates = candidates.unionByName(every.join(gone.select("caseid"), "caseid", "left_semi"))
        return candidates.groupBy("caseid").agg(F.max("report_id").alias("report_id"))

    def _tables(self, held: Snapshot, latest: DataFrame) -> Tables:
        """The tables of one version, restricted to the quarters of some reports.

        ``latest`` has ``report_id`` and ``home``, the report's quarter. Their children are in
        the same quarter, or among those stored apart from their report.
        """
        homes = {r.home for r in latest.select("home").distinct().collect()}
        out = {LATEST: latest, "demo": self._version(held, "demo", homes), V.HOT_REPORTS: self.hot}
        for name in ("drug", "reac", "outc"):
            layout = store._layout(name)
            near = held.read(self.spark, name, layout, homes).filter(F.col(store.HAS_PARENT) == store.AT_HOME)
            apart = held.read(self.spark, name, layout).filter(F.col(store.HAS_PARENT) == store.APART)
            rows = near.unionByName(apart).select(*S.CLEAN[name].names)
            out[name] = rows.join(latest.select("report_id"), "report_id", "left_semi")
        return out

    # -- the two ways ---------------------------------------------------------

    def refresh(self) -> Snapshot:
        """Bring the views to the store's version; gives theirs."""
        if self.before is None:
            self._rebuild()
        elif self.shown != self.after.version:
            self._apply()
        else:
            return self.held
        replaced = {n: self.replaced.get(n, set()) | snapshots.written_quarters(self.spark, self.root, n, self.load) for n in self.layouts}
        notes = {SHOWS: {"version": self.after.version}, "layouts": {n: s.jsonValue() for n, s in self.layouts.items()}}
        return snapshots.publish(self.spark, self.held, self.load, replaced, notes)

    def _homes(self, held: Snapshot, latest: DataFrame, quarters: Iterable[str] | None = None) -> DataFrame:
        home = self._version(held, "demo", quarters).select("report_id", F.col("quarter").alias("home"))
        return latest.join(home, "report_id")

    def _rebuild(self) -> None:
        self.replaced: dict[str, set[str]] = {n: self.held.quarters(n) for n in self.held.parts}
        tables = {n: self._version(self.after, n, None) for n in ("demo", "drug", "reac", "outc")}
        latest = self._homes(self.after, V.mv_latest_cases(tables))
        self._write(LATEST, latest.withColumnRenamed("home", "quarter"))
        layout = T.StructType.fromDDL("caseid long, report_id long, quarter string")
        self.layouts = {LATEST: layout}
        known = ChainMap({LATEST: self._fresh(LATEST, layout, False), V.HOT_REPORTS: self.hot}, tables)

        def build(name: str) -> None:
            df = TALLIES[name].build(known)
            self.layouts[_tally_path(name)] = _with_quarter(df.schema)
            self._write(_tally_path(name), df)

        together([partial(build, n) for n in TALLIES], TALLIES_AT_ONCE)
        self._finish({n: None for n in VIEWS})

    def _apply(self) -> None:
        """Take away what changed reports contributed, and add what they contribute now."""
        self.layouts = {n: self._layout(n) for n in self.held.notes["layouts"]}
        self.replaced = {}
        touched = materialize(self._touched_ids(), "touched-reports")
        old_latest = self._stored(LATEST)
        newest = materialize(self._newest(), "newest-reports")
        # Reports that are newest in one version only count as touched.
        key = ["caseid", "report_id"]
        left = old_latest.join(newest, key, "left_anti").select("report_id")
        came = newest.join(old_latest, key, "left_anti").select("report_id")
        touched = materialize(touched.union(left).union(came).distinct(), "touched-reports")
        was = materialize(old_latest.join(touched, "report_id", "left_semi").withColumnRenamed("quarter", "home"), "former-reports")
        now = materialize(self._homes(self.after, newest.join(touched, "report_id", "left_semi")), "present-reports")
        before, after = self._tables(self.before, was), self._tables(self.after, now)

        # The list of newest reports itself, in the quarters that lose or gain one.
        self.replaced[LATEST] = _quarters(was.union(now.select(*was.columns)).select(F.col("home").alias("quarter")))
        kept = self._stored(LATEST, self.replaced[LATEST]).join(touched, "report_id", "left_anti")
        self._write(LATEST, kept.unionByName(now.withColumnRenamed("home", "quarter")))

        def change(name: str) -> None:
            tally, path = TALLIES[name], _tally_path(name)
            columns = self.layouts[path].names
            minus = tally.build(before)
            for c in tally.sums:
                minus = minus.withColumn(c, -F.col(c))
            delta = tally.build(after).unionByName(minus)
            if "quarter" not in tally.by:
                delta = delta.withColumn("quarter", F.lit(NO_QUARTER))
            delta = _added(delta.select(*columns), tally)
            delta = materialize(delta.filter(" OR ".join(f"{c} <> 0" for c in tally.sums)), f"delta-{name}")
            self.replaced[path] = quarters = _quarters(delta)
            if quarters:
                total = _added(self._stored(path, quarters).unionByName(delta), tally)
                self._write(path, total.filter(F.col(tally.sums[0]) > 0) if tally.by else total)

        together([partial(change, n) for n in TALLIES], TALLIES_AT_ONCE)
        changed = {n: set().union(*(self.replaced[_tally_path(t)] for t in v.of)) for n, v in VIEWS.items()}
        self._finish({n: None if VIEWS[n].whole and q else q for n, q in changed.items()})

    def _finish(self, quarters: Mapping[str, set[str] | None]) -> None:
        """Views from tallies, in the given quarters (None: in all)."""

        def finish(name: str) -> None:
            wanted = quarters[name]
            if wanted is not None and not wanted:
                self.replaced[name] = set()
                return
            tallies = {}
            for t in VIEWS[name].of:
                df = self._fresh(_tally_path(t), self.layouts[_tally_path(t)], True)
                if "quarter" not in TALLIES[t].by:
                    df = df.drop("quarter")
                elif wanted is not None:
                    df = df.filter(F.col("quarter").isin(*wanted))
                tallies[t] = df
            view = VIEWS[name].finish(tallies)
            self.layouts[name] = _with_quarter(view.schema)
            self.replaced[name] = self.held.quarters(name) if wanted is None else wanted
            self._write(name, view)

        together([partial(finish, n) for n in VIEWS])


def _with_quarter(schema: T.StructType) -> T.StructType:
    """All columns nullable, and a place for the quarter."""
    fields = [T.StructField(f.name, f.dataType) for f in schema if f.name != "quarter"]
    return T.StructType([*fields, T.StructField("quarter", T.StringType())])


def _added(df: DataFrame, tally: Tally) -> DataFrame:
    return df.groupBy(*dict.fromkeys([*tally.by, "quarter"])).agg(*[F.sum(c).alias(c) for c in tally.sums]).select(*df.columns)


def refresh(spark: SparkSession, store_root: str, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Bring the views below ``root`` to the newest version of the store (or a given one).

    The first time all of it is built; from then on by what changed since the version that
    the views show. Readers of the views see the former state until all are ready. The result is
    that of building the views anew. Gives the ten views.
    """
    Upkeep(spark, store_root, root, version).refresh()
    return read_views(spark, root)


def read_views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The ten views as they stand, all of one version."""
    held = snapshots.current(spark, root)
    layouts = {n: T.StructType.fromJson(held.notes["layouts"][n]) for n in (LATEST, *VIEWS)}
    out = {n: held.read(spark, n, layout) for n, layout in layouts.items()}
    out[LATEST] = out[LATEST].select("caseid", "report_id")
    return out


def medians(spark: SparkSession, root: str, quarters: Iterable[str], *by: str) -> DataFrame:
    """Exact median and mean age of primary suspects' patients over any set of quarters.

    From the stored counts of ages: those of several quarters add up, medians do not. ``by``
    are columns among ``drugname_clean``, ``sex`` and ``age_group``; drug rows weigh.
    """
    held = snapshots.current(spark, root)
    name = _tally_path("ages")
    ages = held.read(spark, name, T.StructType.fromJson(held.notes["layouts"][name]), quarters)
    known = ages.filter("age_years IS NOT NULL").groupBy(*by, "age_years").agg(F.sum("rows").alias("rows"))
    return known.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        R.mean_of_hundredths(F.col("age_years"), F.col("rows")).alias("avg_age"),
        exact_median("age_years", "rows").alias("median_age"),
    )
