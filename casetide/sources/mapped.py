"""The domain tables, mapped from the order tables of the test data.

Each order is a report, each line item a drug and a reaction of it. The raw tables
carry the same oddities as real files (mixed date spellings, units, untidy names),
so the cleaners do their full work on them. Keys stay numeric: what is known about
the partitioning of ``o_orderkey`` is then known for ``report_id``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide.functions.clean import quarter_of
from casetide.operators.cleaning import clean_table
from casetide.schemas import TABLES

# Questions put in front of the log's filler texts, by conversation number.
QUESTIONS = (
    "Which drugs have the most reports this year?",
    "List side effect entries for cold ring",
    "Did anyone die? Show fatal outcomes",
    "Which countries sent a report?",
    "Show the PRR signal for hot gear",
    "Age distribution of patient reports",
    "Reporting trend over time",
    "Outcome counts per drug",
    "Does red bolt cause dizziness?",
    "Find case 12345678",
    "Death after blue rod -- please check",
    "Most common reaction; DROP everything",
    "Where does this report come from /* hidden */ exactly?",
)

# Statements of the log, by conversation number. What stands in braces comes from the data:
# a number, a word and the text of the turn, and a chain of partial queries.
STATEMENTS = (
    "SELECT drugname_clean, ps_count FROM mv_top_drugs WHERE ps_count < {number} LIMIT {number}",
    "WITH t AS (SELECT quarter FROM mv_quarterly_trends WHERE deaths > {number}) SELECT quarter FROM t",
    "SELECT quarter FROM demo WHERE age_years < {number}; DROP TABLE demo;",
    "SELECT name FROM {word}_patients LIMIT {number}",
    "SELECT report_count FROM mv_top_reactions WHERE reaction_term = '{word}' LIMIT {number}",
    "SELECT 'CANNOT_ANSWER: no column {word}' AS error;",
    "   ",
    "UPDATE demo SET age_years = {number}",
    "SELECT relname FROM pg_catalog.pg_class LIMIT {number}",
    "SELECT system('{word}') FROM demo",
    "SELECT a.quarter FROM drug a JOIN reac b ON a.report_id = b.report_id LIMIT {number};",
    "SELECT quarter FROM demo WHERE reporter_country IN ('{text}')",
    "{chain}SELECT quarter FROM outc WHERE outc_cod = '{word}'",
)


def _pick(index: Column, values: dict[int, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for number, value in values.items():
        chosen = F.when(index == number, F.lit(value)).otherwise(chosen)
    return chosen


class _Planned(Mapping):
    def __init__(self, bed: Bed):
        self._bed = bed
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._tables:
            self._tables[name] = clean_table(self._bed.raw(name), name)
        return self._tables[name]

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


_BEDS: dict[tuple[str, str], Bed] = {}


def bed(spark: SparkSession, sf_dir: str) -> Bed:
    """The tables over a folder; planned once for a session."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _BEDS:
        _BEDS[where] = Bed(spark, sf_dir)
    return _BEDS[where]


class Bed:
    """Raw and cleaned domain tables over one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables = _Planned(self)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- raw tables ---------------------------------------------------------

    def raw(self, table: str) -> DataFrame:
        return getattr(self, f"_raw_{table}")()

    def _reports(self) -> DataFrame:
        orders = self.source("orders")
        return orders.select(
            F.col("o_orderkey").alias("report_id"),
            F.floor(F.col("o_orderkey") / 4).alias("caseid"),
            quarter_of(F.col("o_orderdate")).alias("quarter"),
            *orders.columns[1:],
        )

    def _lines(self) -> DataFrame:
        lines = self.source("lineitem").withColumnRenamed("l_orderkey", "report_id")
        reports = self._reports().select("report_id", "caseid", "quarter", "o_orderdate")
        return lines.join(reports, "report_id")

    def _priority(self) -> Column:
        return F.substring("o_orderpriority", 1, 1).cast("int")

    def _raw_demo(self) -> DataFrame:
        number, day = F.col("report_id"), F.col("o_orderdate")
        version = F.floor((number % 4) / 2).cast("int")
        people = self.source("customer").join(
            self.source("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return (
            self._reports()
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "report_id",
                "caseid",
                version.alias("caseversion"),
                F.when(version == 0, "I").otherwise("F").alias("i_f_code"),
                F.when(number % 5 == 0, F.date_format(day, "yyyyMMdd"))
                .when(number % 5 == 1, F.date_format(day, "yyyyMM"))
                .when(number % 5 == 2, F.date_format(day, "yyyy"))
                .when(number % 5 == 3, F.date_format(day, "MM/dd/yyyy"))
                .otherwise("00000000")
                .alias("event_dt"),
                F.date_format(day, "yyyyMMdd").alias("fda_dt"),
                F.when(F.col("o_orderstatus") == "F", "EXP")
                .when(F.col("o_orderstatus") == "O", "PER")
                .otherwise("DIR")
                .alias("rept_cod"),
                (F.col("o_custkey") % 120).cast("string").alias("age"),
                _pick(
                    number % 7, {0: "YR", 1: "DEC", 2: "MON", 3: "WK", 4: "DY", 5: "HR"}
                ).alias("age_cod"),
                _pick(number % 5, {0: "M", 1: "F", 2: "m", 3: "UNK"}).alias("sex"),
                (F.col("c_acctbal") / 10).alias("wt"),
                _pick(number % 3, {0: "KG", 1: "LBS", 2: "GMS"}).alias("wt_cod"),
                _pick(self._priority(), {1: "MD", 2: "PH", 3: "CN", 4: "LW", 5: "OT"}).alias(
                    "occp_cod"
                ),
                F.col("n_name").alias("reporter_country"),
                F.col("n_name").alias("occr_country"),
                "quarter",
            )
        )

    def _raw_drug(self) -> DataFrame:
        seq = F.col("l_linenumber")
        flag = F.col("l_returnflag")
        parts = self.source("part").select("p_partkey", "p_name", "p_type")
        untidy = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  "))
        return (
            self._lines()
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "report_id",
                "caseid",
                seq.alias("drug_seq"),
                F.when(seq <= 2, "PS")
                .when(seq <= 4, "SS")
                .when(seq == 5, "I")
                .otherwise("C")
                .alias("role_cod"),
                untidy.alias("drugname"),
                F.col("p_type").alias("prod_ai"),
                F.when(flag == "R", "oral ").when(flag == "A", "Intravenous").alias("route"),
                F.col("l_quantity").alias("dose_amt"),
                F.lit("MG").alias("dose_unit"),
                F.col("p_partkey").cast("string").alias("nda_num"),
                "quarter",
            )
        )

    def _raw_reac(self) -> DataFrame:
        return self._lines().select(
            "report_id",
            "caseid",
            F.concat(F.lit("pt "), (F.col("l_suppkey") % 10).cast("string")).alias("pt"),
            "quarter",
        )

    def _raw_outc(self) -> DataFrame:
        """One code by order status and one by priority; a part of the reports has none."""
        status, priority = F.col("o_orderstatus"), self._priority()
        by_status = F.when(status == "F", "DE").when(status == "O", "HO")
        by_status = by_status.when((status == "P") & (priority != 3), "LT")
        by_priority = F.when(priority == 1, "DS").when(priority == 5, "OT")
        return (
            self._reports()
            .select(
                "report_id",
                "caseid",
                F.explode(F.array(by_status, by_priority)).alias("outc_cod"),
                "quarter",
            )
            .filter(F.col("outc_cod").isNotNull())
        )

    def _raw_ther(self) -> DataFrame:
        seq = F.col("l_linenumber")
        return self._lines().select(
            "report_id",
            "caseid",
            seq.alias("drug_seq"),
            F.date_format("o_orderdate", "yyyyMMdd").alias("start_dt"),
            F.date_format("l_shipdate", "yyyyMM").alias("end_dt"),
            F.col("l_quantity").alias("dur"),
            _pick(seq % 6, {0: "YR", 1: "MON", 2: "WK", 3: "DY", 4: "HR"}).alias("dur_cod"),
            "quarter",
        )

    def _raw_indi(self) -> DataFrame:
        parts = self.source("part").select("p_partkey", "p_type", "p_brand")
        return (
            self._lines()
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "report_id",
                "caseid",
                F.col("l_linenumber").alias("drug_seq"),
                F.concat("p_type", F.lit("'s non-"), "p_brand").alias("indi_pt"),
                "quarter",
            )
        )

    def _raw_rpsr(self) -> DataFrame:
        return self._reports().select(
            "report_id",
            "caseid",
            _pick(self._priority(), {1: "FGN", 2: "HP", 3: "LIT", 4: "CSM", 5: "OTC"}).alias(
                "rpsr_cod"
            ),
            "quarter",
        )

    # -- cleaned tables -----------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self._tables[name]

    def tables(self) -> Mapping[str, DataFrame]:
        """All tables by name; each is planned when it is first asked for."""
        return self._tables

    def mappings(self) -> DataFrame:
        """Brand list: one entry per product name; names starting with 'old' are not listed."""
        return (
            self.source("part")
            .filter(~F.col("p_name").startswith("old"))
            .groupBy(F.upper("p_name").alias("brand_name"))
            .agg(F.min("p_type").alias("generic_name"), F.min("p_brand").alias("atc_code"))
        )

    def query_log(self) -> DataFrame:
        turns = self.source("conversations").filter(F.col("role") == "user")
        events = self.source("events").select("event_id", "ts", "event_type", "value")
        conv, text = F.col("conv_id"), F.col("text")
        chars = F.length(text)
        filled = {
            "number": (chars * (conv % 97 + 1)).cast("string"),
            "word": F.regexp_extract(F.lower(text), "[a-z]+", 0),
            "text": F.repeat(F.replace(text, F.lit("'"), F.lit("")), F.lit(20)),
            "chain": F.repeat(F.lit("SELECT 1 UNION ALL "), (chars % 12).cast("int")),
        }
        statement = _pick(conv % len(STATEMENTS), dict(enumerate(STATEMENTS)))
        for name, value in filled.items():
            statement = F.replace(statement, F.lit(f"{{{name}}}"), value)
        log = turns.withColumn("event_id", conv * 8 + F.col("turn")).join(
            events, "event_id", "left"
        )
        return log.select(
            F.concat(
                _pick(conv % len(QUESTIONS), dict(enumerate(QUESTIONS))), F.lit(" "), F.col("text")
            ).alias("query_text"),
            statement.alias("generated_sql"),
            F.floor(F.col("value") * 100 + 0.5).cast("int").alias("response_time_ms"),
            F.col("turn").cast("int").alias("rows_returned"),
            (F.col("event_type") == "view").alias("from_cache"),
            F.when(F.col("event_type") == "error", "timeout").alias("error_message"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
