"""Headline timings as one JSON line.

The steps follow the life of the data: clean and store the tables, save them in buckets
of reports, refresh the standing views, then run reports on the stored views and the
heavy analyses on the bucketed tables. ``direct_*`` queries run on the given tables, cleaning
included. Loading, bucketing and the refresh are single cold runs, all else is the median of
three; the JSON line names the single runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame

from casetide import catalog
from casetide.plans import answers, heavy, reports, views
from casetide.plans.skew import HOT_REPORTS
from casetide.runtime import local_session, scratch_path
from casetide.schemas import TABLES
from casetide.sources import store
from casetide.sources.mapped import bed

DIRECT = ("mv_signal_prr", "mv_drug_reaction_pairs", "mv_quarterly_trends", "prr_full")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def median(work, times: int = 3) -> float:
    return statistics.median(seconds(work) for _ in range(times))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    timed: dict[str, float] = {}

    raw = {name: bed(spark, sf_dir).raw(name) for name in TABLES}
    root, view_root = scratch_path(spark, "bench"), scratch_path(spark, "bench-views")
    timed["load_tables"] = seconds(lambda: store.write_quarter(store.clean_all(raw), root))
    stored = {name: store.read_table(spark, root, name) for name in TABLES}
    t = {HOT_REPORTS: store.stored_tables(spark, root)[HOT_REPORTS]}
    timed["bucket_tables"] = seconds(
        lambda: t.update(store.bucket_tables(stored, root, int(cpus), "bench_"))
    )
    timed["refresh_views"] = seconds(lambda: views.refresh_views(spark, t, view_root))
    v = {name: spark.read.parquet(f"{view_root}/{name}") for name in views.VIEWS}
    drug = catalog.DRUG

    on_views = {
        "top_drugs": lambda: reports.top_drugs(v),
        "drug_reactions": lambda: reports.drug_reactions(v, drug),
        "drug_outcomes": lambda: reports.drug_outcomes(v, drug),
        "drug_signal": lambda: reports.drug_signal(v, drug),
        "drug_demographics": lambda: reports.drug_demographics(v, drug),
        "death_top_drugs": lambda: reports.death_top_drugs(v),
        "country_distribution": lambda: reports.country_distribution(v),
        "quarterly_trends": lambda: reports.quarterly_trends(v),
        "top_reactions": lambda: reports.top_reactions(v),
        "ex_compare_deaths": lambda: answers.compare_deaths(v, ["cold ring", "gear"]),
    }
    on_tables = {
        "db_summary": lambda: reports.db_summary(t),
        "prr_full": lambda: heavy.prr_full(t),
        "drug_trend": lambda: heavy.drug_trend(t, drug),
        "polypharmacy": lambda: heavy.polypharmacy(t),
        "drug_pairs_serious": lambda: heavy.drug_pairs_serious(t),
        "ex_drug_pairs": lambda: heavy.drug_pairs(t),
        "ex_reporter_type": lambda: answers.reporter_type(t),
    }
    for name, build in {**on_views, **on_tables}.items():
        timed[name] = median(lambda build=build: run(build()))
    for name in DIRECT:
        build = catalog.queries()[name]
        timed[f"direct_{name}"] = median(lambda build=build: run(build(spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total seconds of load, view refresh and queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in timed.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "single_runs": ["load_tables", "bucket_tables", "refresh_views"],
                "cores": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
