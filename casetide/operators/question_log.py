"""Batch work over the log of analysts' questions and the SQL run for them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.functions.clean import strip
from casetide.schemas import TABLES

# Text taken out of questions, and the longest question kept.
MAX_QUESTION = 1000
REMOVED_FROM_QUESTIONS = (
    r"--.*$",
    r"/\*.*?\*/",
    r";\s*\w",
    r"\bDROP\b",
    r"\bDELETE\b",
    r"\bTRUNCATE\b",
)

# Patterns of lower-case questions and the view that answers them, first match.
ROUTES = (
    (r"\b(top|most|common|frequent)\b.*\b(drug|medication|reaction|adverse|reports?)\b", "mv_top_drugs"),
    (r"\b(drug|medication)\b.*\b(most|highest|top|frequent)\b", "mv_top_drugs"),
    (r"\b(reaction|side effect|adverse event).*\bfor\b", "mv_drug_reaction_pairs"),
    (r"\b(death|fatal|mortality|died)\b", "mv_death_by_drug"),
    (r"\b(country|countries|nation|where)\b.*\breport", "mv_reports_by_country"),
    (r"\b(signal|prr|proportional|ror|ratio)\b", "mv_signal_prr"),
    (r"\b(age|gender|sex|demographic|distribution)\b.*\b(drug|medication|patient|aspirin|warfarin|report)\b", "mv_age_sex_distribution"),
    (r"\bage distribution\b", "mv_age_sex_distribution"),
    (r"\b(trend|over time|quarterly|quarter)\b", "mv_quarterly_trends"),
    (r"\boutcome\b.*\b(drug|medication)\b", "mv_drug_outcomes"),
)
VIEW_ROUTE, TABLE_ROUTE = "materialized_view:", "raw_tables"

# Words that call for a caveat; the first list wins.
CAUSATION_WORDS = ("cause", "causes", "responsible", "proven", "definitely")
DEATH_WORDS = ("death", "fatal")

# Limits and blocked names of logged statements.
MAX_SQL, MAX_LIMIT, MAX_SELECTS = 5000, 10000, 8
BLOCKED_WORDS = (
    "DROP", "DELETE", "UPDATE", "INSERT", "TRUNCATE", "ALTER", "CREATE", "REPLACE", "GRANT",
    "REVOKE", "EXEC", "EXECUTE", "CALL", "DO", "COPY", "VACUUM", "ANALYZE", "CLUSTER", "REINDEX",
    "REFRESH", "NOTIFY", "LISTEN", "UNLISTEN", "SET", "RESET", "SHOW", "dblink",
)
BLOCKED_PARTS = (
    "pg_read_file", "pg_ls_dir", "pg_stat_file", "lo_import", "lo_export", "pg_exec", "pg_sleep",
)
BLOCKED_SCHEMAS = (
    "pg_catalog", "information_schema", "pg_toast", "pg_temp", "public.pg_", "pg_stat",
)
BLOCKED_FUNCTIONS = (
    "pg_sleep", "pg_cancel_backend", "pg_terminate_backend", "system", "copy_from",
)
READABLE_VIEWS = (
    "mv_drug_reaction_pairs",
    "mv_drug_outcomes",
    "mv_death_by_drug",
    "mv_reports_by_country",
    "mv_signal_prr",
    "mv_age_sex_distribution",
    "mv_quarterly_trends",
    "mv_top_drugs",
    "mv_top_reactions",
)

# Upper bounds of the latency bands, in milliseconds.
FAST_BELOW, MEDIUM_BELOW = 500, 2000

# Unicode word classes and plain line ends in the JVM's patterns.
_UNICODE = "(?Ud)"


def log_history(log: DataFrame, limit: int = 20) -> DataFrame:
    """The newest entries."""
    return (
        log.orderBy(F.desc_nulls_last("created_at"), "query_text", "generated_sql")
        .limit(limit)
        .select(
            F.col("query_text").alias("question"),
            "generated_sql",
            "response_time_ms",
            "rows_returned",
            "from_cache",
            F.col("error_message").alias("error"),
            F.col("created_at").alias("timestamp"),
        )
    )


def sanitized(question: Column, longest: int = MAX_QUESTION) -> Column:
    """Question without SQL comments, statement breaks and destructive words, cut at ``longest``."""
    text = F.substring(F.coalesce(question, F.lit("")), 1, longest)
    for pattern in REMOVED_FROM_QUESTIONS:
        text = F.regexp_replace(text, f"(?imUd){pattern}", "")
    return strip(text)


def log_sanitize(log: DataFrame, longest: int = MAX_QUESTION) -> DataFrame:
    """Tidied questions, and whether one was longer than ``longest`` characters and was cut."""
    question = F.col("query_text")
    return log.select(
        "query_text",
        sanitized(question, longest).alias("sanitized"),
        (F.length(F.coalesce(question, F.lit(""))) > longest).alias("was_cut"),
    )


def route(question: Column) -> Column:
    """View that suits a question, or the tables themselves. A tag only."""
    text = F.lower(F.coalesce(question, F.lit("")))
    target = F.when(F.lit(False), "")
    for pattern, view in ROUTES:
        target = target.when(text.rlike(_UNICODE + pattern), VIEW_ROUTE + view)
    return target.otherwise(TABLE_ROUTE)


def log_route(log: DataFrame) -> DataFrame:
    return log.select("query_text", route(F.col("query_text")).alias("route"))


def log_route_counts(log: DataFrame) -> DataFrame:
    routed = log.select(route(F.col("query_text")).alias("route"))
    return routed.groupBy("route").agg(F.count("*").alias("questions"))


def warning(question: Column) -> Column:
    """Which caveat a question calls for: ``causation``, ``death`` or none."""
    text = F.lower(question)

    def mentions(words: Iterable[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    return F.when(mentions(CAUSATION_WORDS), "causation").when(mentions(DEATH_WORDS), "death")


def log_warning(log: DataFrame) -> DataFrame:
    return log.select("query_text", warning(F.col("query_text")).alias("warning"))


def readable_names(prefix: str = "") -> list[str]:
    """Names a logged statement may read; ``prefix`` as given when registering the tables."""
    return [*[prefix + t for t in (*TABLES, "quarter_metadata")], *READABLE_VIEWS]


def log_sql_audit(log: DataFrame, prefix: str = "") -> DataFrame:
    """What speaks against each logged statement, and the first reason as ``verdict``.

    Names are compared without regard to case throughout.
    """
    given = F.coalesce(F.col("generated_sql"), F.lit(""))
    sql = F.regexp_replace(strip(given), r";+\z", "")
    upper = F.upper(sql)
    # Quoted text and comments cannot end a statement. A doubled quote parts two quoted texts,
    # which is as good here; a group repeated per character would exhaust the stack.
    bare = F.regexp_replace(sql, r"(?s)'[^']*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ")
    words = "|".join(BLOCKED_WORDS).upper()
    functions = "|".join(BLOCKED_FUNCTIONS).upper()

    def has_any(parts: Iterable[str]) -> Column:
        hit = F.lit(False)
        for part in parts:
            hit = hit | upper.contains(part.upper())
        return hit

    read = F.transform(
        F.regexp_extract_all(
            sql, F.lit(r"(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_.]*)"), F.lit(1)
        ),
        lambda name: F.lower(F.element_at(F.split(name, r"\."), -1)),
    )
    own = F.transform(
        F.regexp_extract_all(sql, F.lit(r"(?iU)\b(\w+)\s+AS\s*\("), F.lit(1)), F.lower
    )
    allowed = F.array(*[F.lit(n) for n in readable_names(prefix)])
    unknown = F.array_sort(F.array_except(F.array_except(read, own), allowed))
    limits = F.regexp_extract_all(sql, F.lit(r"(?i)\bLIMIT\s+(\d+)"), F.lit(1))
    selects = (F.length(upper) - F.length(F.replace(upper, F.lit("SELECT"), F.lit("")))) / 6
    first_word = F.regexp_extract(upper, r"^\s*(\S+)", 1)
    checks = {
        "is_empty": strip(given) == "",
        "too_long": F.length(given) > MAX_SQL,
        "cannot_answer": strip(sql).startswith("SELECT 'CANNOT_ANSWER:"),
        "not_select": ~first_word.isin("SELECT", "WITH"),
        "many_statements": bare.rlike(r"(?s);.*[^\s;]"),
        "blocked_keyword": upper.rlike(rf"(?U)\b({words})\b") | has_any(BLOCKED_PARTS),
        "blocked_schema": has_any(BLOCKED_SCHEMAS),
        "unknown_table": F.size(unknown) > 0,
        "limit_too_high": F.exists(
            limits, lambda n: F.coalesce(n.try_cast("bigint"), F.lit(MAX_LIMIT + 1)) > MAX_LIMIT
        ),
        "too_complex": selects > MAX_SELECTS,
        "blocked_function": upper.rlike(rf"(?U)\b({functions})\b"),
    }
    verdict = F.when(F.lit(False), "")
    for name in checks:
        verdict = verdict.when(F.col(name), name)
    return log.select(
        "query_text",
        "generated_sql",
        *[check.alias(name) for name, check in checks.items()],
        F.array_join(unknown, ",").alias("unknown_tables"),
    ).withColumn("verdict", verdict.otherwise("ok"))


def fingerprint(sql: Column) -> Column:
    """Shape of a statement: lower case, single blanks, numbers and limits masked."""
    text = strip(F.regexp_replace(F.lower(sql), r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"(?U)\blimit\s+\d+", "limit N")
    return F.regexp_replace(text, r"(?U)\b\d+\b", "?")


def sql_fingerprint(log: DataFrame) -> DataFrame:
    """Statements of the log by shape."""
    shaped = log.select(fingerprint(F.col("generated_sql")).alias("fingerprint"))
    return shaped.groupBy("fingerprint").agg(F.count("*").alias("statements"))


def log_latency(log: DataFrame) -> DataFrame:
    """Answered questions by latency band."""
    millis = F.col("response_time_ms")
    band = F.when(millis < FAST_BELOW, "fast").when(millis < MEDIUM_BELOW, "medium")
    bands = log.filter(millis.isNotNull()).select(band.otherwise("slow").alias("band"))
    return bands.groupBy("band").agg(F.count("*").alias("questions"))
