"""Cleaning expressions for single values. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide import schemas as S

# The blanks of the files' character set, and a run that needs tidying.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_BLANK_RUN = f"[{BLANKS}]{{2,}}|[{BLANKS[1:]}]"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*$"
# A non-letter other than a space in front of a letter, and the mark put between them.
_WORD_START = r"([^\p{L} ])(?=\p{L})"
_MARK = "\x02 "


def strip(text: Column) -> Column:
    """Remove every kind of blank at both ends (plain ``trim`` only knows spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def lookup(code: Column, labels: Mapping[str, object], default: Column) -> Column:
    """Value of ``code`` in a fixed list, or ``default`` for unknown and null codes."""
    listed = ", ".join(f"{k!r}, {v!r}" + "D" * isinstance(v, float) for k, v in labels.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({listed})"), code), default)


def number(value: Column) -> Column:
    """Double, or null where the text is not a plain decimal number.

    Spark also reads ``NaN``, ``Infinity``, ``5d`` and hexadecimal; one such value would
    spoil every mean. Numbers pass as they are, if they are finite.
    """
    plain = F.regexp_like(value.cast("string"), F.lit(_NUMBER))
    return F.when(plain, value.try_cast("double"))


def key(value: Column, is_integral: bool = False) -> Column:
    """Whole-number key. Text such as ``12.0`` is a key; unreadable text is null.

    A column that is already integral passes through as is, so the hash
    partitioning of the table it came from is still known to the planner.
    """
    if is_integral:
        return value
    as_long = value.try_cast("bigint")
    return F.coalesce(as_long, number(value).try_cast("bigint"))


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the stored binary value, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def _digits(bare: Column) -> Column:
    # Nearly all dates are digits only; the others go through the pattern.
    plain = F.translate(bare, "0123456789", "") == ""
    return F.when(plain, bare).otherwise(F.regexp_replace(bare, "[^0-9]", ""))


def _day(bare: Column, digits: Column) -> Column:
    slashed = F.coalesce(F.try_to_date(bare, "M/d/yyyy"), F.try_to_date(bare, "d/M/yyyy"))
    # 2024 and 202411 are filled up to the first of the year or month.
    by_size = F.try_to_date(F.rpad(digits, 8, "0101"), "yyyyMMdd")
    day = F.coalesce(
        F.when(bare.contains("/"), slashed), F.when(F.length(digits).isin(4, 6, 8), by_size)
    )
    return F.when(~bare.isin(*S.DATE_SENTINELS), day)


def _in_range(day: Column, first: str = S.FIRST_DATE, last: str = S.LAST_DATE) -> Column:
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)


def parse_event_date(text: Column, first: str = S.FIRST_DATE, last: str = S.LAST_DATE) -> Column:
    """Date from the mixed spellings of the raw files, null outside ``first`` to ``last``.

    The default is the range that the stored format of other readers can hold. Loads note how
    many dates became null, these among them (``store.losses``).

    Slashed text is month/day/year, else day/month/year. Otherwise the digits
    decide by their number: 8 are a day, 6 a month, 4 a year, and the missing
    parts become 1. A reader that tries the long form first would take 202411 for
    the first of January; going by length gives November, as the format says.
    """
    bare = strip(text)
    return _in_range(_day(bare, _digits(bare)), first, last)


def with_event_dates(df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """``parse_event_date`` for columns of a table, each step computed once per row.

    A value that a later step needs several times is a column of its own here; as one
    expression it would be computed again at each mention.
    """

    def step(df: DataFrame, suffix: str, value: Callable[[str], Column]) -> DataFrame:
        return df.withColumns({f"_{name}{suffix}": value(name) for name in texts})

    df = step(df, "_bare", lambda name: strip(texts[name]))
    df = step(df, "_digits", lambda name: _digits(F.col(f"_{name}_bare")))
    df = step(df, "_day", lambda name: _day(F.col(f"_{name}_bare"), F.col(f"_{name}_digits")))
    df = df.withColumns({name: _in_range(F.col(f"_{name}_day")) for name in texts})
    return df.drop(*[f"_{n}_{step}" for n in texts for step in ("bare", "digits", "day")])


def _unit(code: Column) -> Column:
    return F.upper(strip(code.cast("string")))


def age_to_years(age: Column, unit: Column) -> Column:
    """Years, 2 decimals. Not above 150, not zero or less; unknown units are years."""
    years = number(age) * lookup(_unit(unit), S.YEARS_PER_AGE_UNIT, F.lit(1.0))
    return F.when((number(age) > 0) & (years <= 150), half_up(years, 2))


def weight_to_kg(weight: Column, unit: Column) -> Column:
    """Kilograms, 2 decimals, within 0.1 to 700; unknown units are kilograms."""
    kilos = number(weight) * lookup(_unit(unit), S.KG_PER_WEIGHT_UNIT, F.lit(1.0))
    return F.when((number(weight) > 0) & kilos.between(0.1, 700), half_up(kilos, 2))


def duration_to_days(length: Column, unit: Column) -> Column:
    """Days, not rounded. Zero counts as missing; unknown units are days."""
    days = number(length) * lookup(_unit(unit), S.DAYS_PER_DURATION_UNIT, F.lit(1.0))
    return F.when(number(length) != 0, days)


def clean_sex(code: Column) -> Column:
    return lookup(code, S.SEX_LABELS, F.lit(S.UNKNOWN))


def age_group(years: Column) -> Column:
    band = F.when(years.isNull(), S.UNKNOWN)
    for upper, label in S.AGE_BANDS:
        band = band.when(years < upper, label)
    return band.otherwise(S.OLDEST_BAND)


def clean_name(text: Column) -> Column:
    """Drug or ingredient name: upper case, single blanks, empty when missing."""
    return F.regexp_replace(strip(F.upper(F.coalesce(text, F.lit("")))), _BLANK_RUN, " ")


def clean_route(text: Column) -> Column:
    return strip(F.upper(F.coalesce(text, F.lit(S.UNKNOWN))))


def drug_role_label(code: Column) -> Column:
    return lookup(code, S.ROLE_LABELS, F.lit(S.UNKNOWN))


def outcome_label(code: Column) -> Column:
    return lookup(code, S.OUTCOME_LABELS, F.lit(S.UNKNOWN))


def clean_term(text: Column) -> Column:
    """Medical term with a capital after every non-letter (``Crohn'S``), empty when missing.

    ``initcap`` starts words at spaces only, so a marked space goes in front of
    every other word start and is taken out again.
    """
    bare = strip(F.coalesce(text, F.lit("")))
    marked = F.regexp_replace(bare, _WORD_START, f"$1{_MARK}")
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def nonempty(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def quarter_of(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("q"), F.quarter(day).cast("string"))
