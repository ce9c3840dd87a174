"""From the all-text raw tables to the cleaned tables, one projection each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetide import schemas as S
from casetide.functions import clean as C

#: Bits of the columns of ``lossy_columns`` whose text a row's cleaning could not read.
LOST = "_lost"

_INTEGRAL = (T.LongType, T.IntegerType, T.ShortType)


def _key(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("bigint")
    return C.key(F.col(name), isinstance(df.schema[name].dataType, _INTEGRAL))


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def coerce_keys(df: DataFrame) -> DataFrame:
    """Keys as whole numbers; rows without a readable report number are dropped."""
    keys = [k for k in ("report_id", "caseid", "drug_seq") if k in df.columns]
    typed = df.withColumns({k: _key(df, k) for k in keys})
    return typed.filter(F.col("report_id").isNotNull())


def tag_quarter(df: DataFrame, quarter: str | None = None) -> DataFrame:
    """Constant quarter, or the one the reader took from the path, in lower case."""
    value = F.lit(quarter) if quarter else F.col("quarter")
    return df.withColumn("quarter", F.lower(value))


def _prepared(df: DataFrame, quarter: str | None) -> DataFrame:
    return tag_quarter(coerce_keys(df), quarter)


def clean_demo(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter)
    dates = {"event_dt": _text(df, "event_dt"), "fda_dt": _text(df, "fda_dt")}
    numbers = {"_age": C.number(_text(df, "age")), "_wt": C.number(_text(df, "wt"))}
    df = C.with_event_dates(df, dates).withColumns(numbers)
    return (
        df.withColumns(
            {
                "caseversion": _key(df, "caseversion").cast("int"),
                "age_years": C.age_to_years(F.col("_age"), _text(df, "age_cod")),
                "weight_kg": C.weight_to_kg(F.col("_wt"), _text(df, "wt_cod")),
                "sex": C.clean_sex(_text(df, "sex")),
            }
        )
        .withColumn("age_group", C.age_group(F.col("age_years")))
        .drop("_age", "_wt")
    )


def clean_drug(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter)
    return df.withColumns(
        {
            "drug_seq": _key(df, "drug_seq").cast("int"),
            "drugname_clean": C.clean_name(_text(df, "drugname")),
            "prod_ai_clean": C.clean_name(_text(df, "prod_ai")),
            "drug_role": C.drug_role_label(_text(df, "role_cod")),
            "route_clean": C.clean_route(_text(df, "route")),
            "dose_amt": C.number(_text(df, "dose_amt")),
        }
    )


def clean_reac(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter).filter(F.col("pt").isNotNull())
    return df.withColumn("pt_clean", C.clean_term(F.col("pt")))


def clean_outc(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter).filter(F.col("outc_cod").isNotNull())
    return df.withColumn("outcome_label", C.outcome_label(F.col("outc_cod")))


def clean_ther(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter)
    dates = {"start_dt": _text(df, "start_dt"), "end_dt": _text(df, "end_dt")}
    return C.with_event_dates(df, dates).withColumns(
        {
            "drug_seq": _key(df, "drug_seq").cast("int"),
            "dur_days": C.duration_to_days(_text(df, "dur"), _text(df, "dur_cod")),
        }
    )


def clean_indi(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    df = _prepared(raw, quarter)
    return df.withColumns(
        {
            "drug_seq": _key(df, "drug_seq").cast("int"),
            "indi_pt_clean": C.clean_term(_text(df, "indi_pt")),
        }
    )


def clean_rpsr(raw: DataFrame, quarter: str | None = None) -> DataFrame:
    return _prepared(raw, quarter)


CLEANERS: Mapping[str, Callable[..., DataFrame]] = {
    "demo": clean_demo,
    "drug": clean_drug,
    "reac": clean_reac,
    "outc": clean_outc,
    "ther": clean_ther,
    "indi": clean_indi,
    "rpsr": clean_rpsr,
}


def conform_schema(df: DataFrame, table: str, *further: str) -> DataFrame:
    """The table's fixed columns in order; absent ones are null. ``further`` ones follow."""
    layout = S.CLEAN[table]
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in layout
        ],
        *further,
    )


def capture_drift(df: DataFrame, table: str) -> DataFrame:
    """Columns the cleaned table has no place for, as one JSON text of the non-null ones."""
    known = set(S.CLEAN[table].names) | {"quarter", LOST}
    surplus = [c for c in df.columns if c not in known]
    packed = F.to_json(F.struct(*surplus)) if surplus else F.lit("{}")
    return df.withColumn(S.DRIFT_COLUMN, packed)


def lossy_columns(table: str) -> list[str]:
    """Raw columns that cleaning turns into dates, numbers or keys, in a fixed order."""
    typed = {name: name for name in S.RAW_COLUMNS[table] if name in S.CLEAN[table].names and name not in ("report_id", "quarter")}
    typed = {r: c for r, c in typed.items() if not isinstance(S.CLEAN[table][c].dataType, T.StringType)}
    return [*typed, *(r for r in _READ_AS if r in S.RAW_COLUMNS[table] and _READ_AS[r] in S.CLEAN[table].names)]


# Raw columns whose cleaned column has another name.
_READ_AS = {"age": "age_years", "wt": "weight_kg", "dur": "dur_days"}


_MARK = "_has_"


def _with_marks(raw: DataFrame, table: str) -> DataFrame:
    """``raw`` with a column for each of ``lossy_columns`` that says whether there is a text."""
    has = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) if c in raw.columns else F.lit(False)
    return raw.withColumns({_MARK + c: has(c) for c in lossy_columns(table)})


def clean_table(raw: DataFrame, table: str, quarter: str | None = None, losses: bool = False) -> DataFrame:
    """Clean, pack surplus columns and bring one table into its fixed layout.

    With ``losses`` there is one more column, ``LOST``: a bit for each of ``lossy_columns``
    whose text is not blank and became null.
    """
    if not losses:
        return conform_schema(capture_drift(CLEANERS[table](raw, quarter), table), table)
    cleaned = CLEANERS[table](_with_marks(raw, table), quarter)
    mask = F.lit(0)
    for i, c in enumerate(lossy_columns(table)):
        mask = mask.bitwiseOR(F.when(F.col(_MARK + c) & F.col(_READ_AS.get(c, c)).isNull(), 1 << i).otherwise(0))
    cleaned = cleaned.withColumn(LOST, mask).drop(*[c for c in cleaned.columns if c.startswith(_MARK)])
    return conform_schema(capture_drift(cleaned, table), table, LOST)


def resolve_generic(drug: DataFrame, mappings: DataFrame) -> DataFrame:
    """Generic name and class code of each drug row, null where the brand is not listed.

    One row per brand is taken from the list, by the smallest generic name.
    """
    brands = (
        mappings.withColumn("drugname_clean", C.clean_name(F.col("brand_name")))
        .groupBy("drugname_clean")
        .agg(F.min(F.struct("generic_name", "atc_code")).alias("_entry"))
        .select("drugname_clean", "_entry.generic_name", "_entry.atc_code")
    )
    return drug.join(brands, "drugname_clean", "left")
