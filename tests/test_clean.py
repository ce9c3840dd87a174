"""Hand-worked tables for every cleaning expression."""

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casetide.functions import clean as C
from casetide.operators import cleaning


def apply(spark, expression, values, schema):
    data = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, f"i int, {schema}")
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


DATES = [
    ("20240315", dt.date(2024, 3, 15)),
    ("202411", dt.date(2024, 11, 1)),
    ("202412", dt.date(2024, 12, 1)),
    ("2024", dt.date(2024, 1, 1)),
    ("3/5/2024", dt.date(2024, 3, 5)),
    ("03/05/2024", dt.date(2024, 3, 5)),
    ("15/03/2024", dt.date(2024, 3, 15)),
    ("1/8/2012", dt.date(2012, 1, 8)),
    ("2024-03-15", dt.date(2024, 3, 15)),
    (" 20240315 ", dt.date(2024, 3, 15)),
    ("2024/03/15", dt.date(2024, 3, 15)),
    ("20241399", None),
    ("202413", None),
    ("20230229", None),
    ("13/13/2024", None),
    ("2024031", None),
    ("12340101", None),
    ("", None),
    ("0", None),
    ("00000000", None),
    ("00000", None),
    ("0000", None),
    ("99999999", None),
    ("soon", None),
    (None, None),
]


def test_event_dates(spark):
    texts = [text for text, _ in DATES]
    found = apply(spark, C.parse_event_date(F.col("s")), texts, "s string")
    assert dict(zip(texts, found)) == dict(DATES)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    table = C.with_event_dates(df, {"day": F.col("s"), "again": F.col("s")})
    assert table.columns == ["s", "day", "again"]
    assert {r.s: r.day for r in table.collect()} == dict(DATES)
    assert table.filter("day is distinct from again").count() == 0


AGES = [
    (("45", "YR"), 45.0),
    (("4", "DEC"), 40.0),
    (("18", "MON"), 1.5),
    (("10", "WK"), 0.19),
    (("100", "DY"), 0.27),
    (("8766", "HR"), 1.0),
    (("45", " yr "), 45.0),
    (("45", "XX"), 45.0),
    (("45", None), 45.0),
    (("150", "YR"), 150.0),
    (("150.01", "YR"), None),
    (("16", "DEC"), None),
    (("0", "YR"), None),
    (("-1", "YR"), None),
    (("n/a", "YR"), None),
    ((None, "YR"), None),
]


def test_ages(spark):
    given_, wanted = zip(*AGES)
    expression = C.age_to_years(F.col("a"), F.col("u"))
    assert apply(spark, expression, given_, "a string, u string") == list(wanted)


WEIGHTS = [
    (("70", "KG"), 70.0),
    (("154", "LBS"), 69.85),
    (("3500", "GMS"), 3.5),
    (("70", None), 70.0),
    (("70", "XX"), 70.0),
    (("0.1", "KG"), 0.1),
    (("0.09", "KG"), None),
    (("700", "KG"), 700.0),
    (("700.1", "KG"), None),
    (("0", "KG"), None),
    (("-5", "KG"), None),
    ((None, None), None),
]


def test_weights(spark):
    given_, wanted = zip(*WEIGHTS)
    expression = C.weight_to_kg(F.col("w"), F.col("u"))
    assert apply(spark, expression, given_, "w string, u string") == list(wanted)


def test_durations(spark):
    given_ = [("2", "YR"), ("2", "MON"), ("2", "WK"), ("2", "DY"), ("12", "HR"), ("2", "XX"),
              ("2", None), ("0", "DY"), (None, "DY"), ("-1", "DY")]
    expression = C.duration_to_days(F.col("d"), F.col("u"))
    found = apply(spark, expression, given_, "d string, u string")
    assert found == [730.5, 60.88, 14.0, 2.0, 0.5, 2.0, 2.0, None, None, -1.0]


def test_code_labels(spark):
    codes = ["M", "m", "F", "f", "UNK", "NS", " M", None]
    assert apply(spark, C.clean_sex(F.col("c")), codes, "c string") == [
        "Male", "Male", "Female", "Female", "Unknown", "Unknown", "Unknown", "Unknown"
    ]
    codes = ["PS", "SS", "C", "I", "ps", None]
    assert apply(spark, C.drug_role_label(F.col("c")), codes, "c string") == [
        "Primary Suspect", "Secondary Suspect", "Concomitant", "Interacting", "Unknown", "Unknown"
    ]
    codes = ["DE", "LT", "HO", "DS", "CA", "RI", "OT", "ZZ", None]
    assert apply(spark, C.outcome_label(F.col("c")), codes, "c string") == [
        "Death", "Life-Threatening", "Hospitalization", "Disability", "Congenital Anomaly",
        "Required Intervention", "Other Serious", "Unknown", "Unknown",
    ]


def test_age_bands(spark):
    ages = [0.0, 1.99, 2.0, 11.99, 12.0, 17.99, 18.0, 44.99, 45.0, 64.99, 65.0, 150.0, None]
    assert apply(spark, C.age_group(F.col("a")), ages, "a double") == [
        "Neonate/Infant (<2y)", "Neonate/Infant (<2y)", "Child (2-11y)", "Child (2-11y)",
        "Adolescent (12-17y)", "Adolescent (12-17y)", "Young Adult (18-44y)",
        "Young Adult (18-44y)", "Middle-Aged (45-64y)", "Middle-Aged (45-64y)",
        "Elderly (65+y)", "Elderly (65+y)", "Unknown",
    ]


def test_names_and_routes(spark):
    names = ["  aspirin \t 100   mg\xa0", "Ibuprofen", "", None, "a\tb"]
    assert apply(spark, C.clean_name(F.col("s")), names, "s string") == [
        "ASPIRIN 100 MG", "IBUPROFEN", "", "", "A B"
    ]
    routes = ["oral ", "Intravenous", None, "two  words"]
    assert apply(spark, C.clean_route(F.col("s")), routes, "s string") == [
        "ORAL", "INTRAVENOUS", "UNKNOWN", "TWO  WORDS"
    ]


def test_terms_follow_title_case(spark):
    terms = ["crohn's disease NON-HODGKIN 3rd", None, "", " \tnausea\n"]
    assert apply(spark, C.clean_term(F.col("s")), terms, "s string") == [
        "Crohn'S Disease Non-Hodgkin 3Rd", "", "", "Nausea"
    ]


LATIN = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(160, 256)])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(LATIN, max_size=30), min_size=40, max_size=60))
def test_text_cleaning_against_python(spark, texts):
    terms = apply(spark, C.clean_term(F.col("s")), texts, "s string")
    assert terms == [t.strip().title() for t in texts]
    names = apply(spark, C.clean_name(F.col("s")), texts, "s string")
    assert names == [re.sub(r"\s+", " ", t.upper().strip()) for t in texts]


def test_keys(spark):
    texts = ["12", "12.0", " 12", "x12", "", None, "9007199254740993"]
    found = apply(spark, C.key(F.col("s")), texts, "s string")
    assert found == [12, 12, 12, None, None, None, 9007199254740993]


def test_rows_without_key_or_term_go(spark, rows):
    raw = spark.createDataFrame(
        [("1", "5", "nausea"), ("x", "5", "nausea"), ("2", None, None), (None, "5", "rash")],
        "report_id string, caseid string, pt string",
    )
    assert rows(cleaning.clean_reac(raw, "2024Q1"), "report_id", "pt_clean", "quarter") == [
        (1, "Nausea", "2024q1")
    ]


def test_layout_drift_and_absent_columns(spark):
    raw = spark.createDataFrame(
        [("1", "5", "nausea", "x", None), ("2", "5", "rash", None, None)],
        "report_id string, caseid string, pt string, site string, extra string",
    )
    table = cleaning.clean_table(raw, "reac", "2024q1")
    assert table.columns == [
        "report_id", "caseid", "quarter", "pt", "pt_clean", "extended_attributes"
    ]
    packed = {r.report_id: r.extended_attributes for r in table.collect()}
    assert packed == {1: '{"site":"x"}', 2: "{}"}
    outc = spark.createDataFrame([("1", "DE")], "report_id string, outc_cod string")
    row = cleaning.clean_table(outc, "outc", "2024q1").collect()[0]
    assert (row.caseid, row.outcome_label, row.extended_attributes) == (None, "Death", "{}")


@pytest.mark.parametrize("brand,generic", [("ASPIRIN", "acid"), ("OTHER", None)])
def test_generic_names(spark, brand, generic):
    drug = spark.createDataFrame([(1, brand)], "report_id long, drugname_clean string")
    known = spark.createDataFrame(
        [(" aspirin", "acid", "A01"), ("ASPIRIN", "zinc", "B02")],
        "brand_name string, generic_name string, atc_code string",
    )
    assert cleaning.resolve_generic(drug, known).collect()[0].generic_name == generic
