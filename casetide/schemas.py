"""Table layouts and the fixed code lists of the adverse-event domain."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = ("demo", "drug", "reac", "outc", "ther", "indi", "rpsr")

# Columns of the raw files, in file order, after header clean-up.
RAW_COLUMNS = {
    "demo": (
        "report_id", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt", "init_fda_dt",
        "fda_dt", "rept_cod", "auth_num", "mfr_num", "mfr_sndr", "lit_ref", "age", "age_cod",
        "age_grp", "sex", "e_sub", "wt", "wt_cod", "rept_dt", "to_mfr", "occp_cod",
        "reporter_country", "occr_country",
    ),
    "drug": (
        "report_id", "caseid", "drug_seq", "role_cod", "drugname", "prod_ai", "val_vbm", "route",
        "dose_vbm", "cum_dose_chr", "cum_dose_unit", "dechal", "rechal", "lot_num", "exp_dt",
        "nda_num", "dose_amt", "dose_unit", "dose_form", "dose_freq",
    ),
    "reac": (
        "report_id", "caseid", "pt", "drug_rec_act",
    ),
    "outc": (
        "report_id", "caseid", "outc_cod",
    ),
    "rpsr": (
        "report_id", "caseid", "rpsr_cod",
    ),
    "ther": (
        "report_id", "caseid", "drug_seq", "start_dt", "end_dt", "dur", "dur_cod",
    ),
    "indi": (
        "report_id", "caseid", "drug_seq", "indi_pt",
    ),
}

DRIFT_COLUMN = "extended_attributes"


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "STRING": T.StringType(),
}


def _layout(text: str) -> T.StructType:
    pairs = [item.split() for item in f"{text}, {DRIFT_COLUMN} STRING".split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The cleaned tables.
CLEAN = {
    "demo": _layout(
        "report_id BIGINT, caseid BIGINT, caseversion INT, quarter STRING, i_f_code STRING, "
        "event_dt DATE, fda_dt DATE, rept_cod STRING, age_years DOUBLE, sex STRING, "
        "weight_kg DOUBLE, age_group STRING, reporter_country STRING, occr_country STRING, "
        "occp_cod STRING"
    ),
    "drug": _layout(
        "report_id BIGINT, caseid BIGINT, drug_seq INT, quarter STRING, role_cod STRING, "
        "drug_role STRING, drugname STRING, drugname_clean STRING, prod_ai STRING, "
        "prod_ai_clean STRING, route STRING, route_clean STRING, dose_amt DOUBLE, "
        "dose_unit STRING, dose_form STRING, dose_freq STRING, nda_num STRING"
    ),
    "reac": _layout("report_id BIGINT, caseid BIGINT, quarter STRING, pt STRING, pt_clean STRING"),
    "outc": _layout(
        "report_id BIGINT, caseid BIGINT, quarter STRING, outc_cod STRING, outcome_label STRING"
    ),
    "ther": _layout(
        "report_id BIGINT, caseid BIGINT, drug_seq INT, quarter STRING, start_dt DATE, "
        "end_dt DATE, dur_days DOUBLE"
    ),
    "indi": _layout(
        "report_id BIGINT, caseid BIGINT, drug_seq INT, quarter STRING, indi_pt STRING, "
        "indi_pt_clean STRING"
    ),
    "rpsr": _layout("report_id BIGINT, caseid BIGINT, quarter STRING, rpsr_cod STRING"),
}

# Columns of the slim Parquet export.
EXPORT_COLUMNS = {
    "demo": (
        "report_id", "caseid", "caseversion", "quarter", "i_f_code", "event_dt", "fda_dt",
        "rept_cod", "age_years", "age_group", "sex", "weight_kg", "reporter_country",
        "occr_country", "occp_cod",
    ),
    "drug": (
        "report_id", "caseid", "drug_seq", "quarter", "role_cod", "drug_role", "drugname_clean",
        "prod_ai_clean", "route_clean", "dose_amt", "dose_unit", "nda_num",
    ),
    "reac": (
        "report_id", "caseid", "quarter", "pt_clean",
    ),
    "outc": (
        "report_id", "caseid", "quarter", "outc_cod", "outcome_label",
    ),
    "indi": (
        "report_id", "caseid", "drug_seq", "quarter", "indi_pt_clean",
    ),
}

# Code lists.
SEX_LABELS = {"M": "Male", "m": "Male", "F": "Female", "f": "Female"}
ROLE_LABELS = {
    "PS": "Primary Suspect",
    "SS": "Secondary Suspect",
    "C": "Concomitant",
    "I": "Interacting",
}
OUTCOME_LABELS = {
    "DE": "Death",
    "LT": "Life-Threatening",
    "HO": "Hospitalization",
    "DS": "Disability",
    "CA": "Congenital Anomaly",
    "RI": "Required Intervention",
    "OT": "Other Serious",
}
SERIOUS_OUTCOMES = ("DE", "LT", "HO")
YEARS_PER_AGE_UNIT = {
    "YR": 1.0,
    "DEC": 10.0,
    "MON": 1.0 / 12.0,
    "WK": 1.0 / 52.18,
    "DY": 1.0 / 365.25,
    "HR": 1.0 / 8766.0,
}
KG_PER_WEIGHT_UNIT = {"KG": 1.0, "LBS": 0.453592, "GMS": 0.001}
DAYS_PER_DURATION_UNIT = {"YR": 365.25, "MON": 30.44, "WK": 7.0, "DY": 1.0, "HR": 1.0 / 24.0}
# Upper bound (exclusive, in years) of each age band, youngest first.
AGE_BANDS = (
    (2, "Neonate/Infant (<2y)"),
    (12, "Child (2-11y)"),
    (18, "Adolescent (12-17y)"),
    (45, "Young Adult (18-44y)"),
    (65, "Middle-Aged (45-64y)"),
)
OLDEST_BAND = "Elderly (65+y)"
UNKNOWN = "Unknown"
DATE_SENTINELS = ("", "0", "00000000", "00000", "0000", "99999999")
# Dates a nanosecond timestamp can hold; anything else counts as unreadable.
FIRST_DATE, LAST_DATE = "1677-09-22", "2262-04-11"
