"""Disproportionality measures over the counts of one drug-reaction pair.

``a`` reports name both, ``n_drug`` the drug, ``n_reac`` the reaction, ``total`` are
all reports. A zero denominator gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signal rule.
SIGNAL_MIN_REPORTS = 3
SIGNAL_MIN_PRR = 2


def _over(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def mean_of_hundredths(value: Column, weight: Column | None = None) -> Column:
    """Mean of values that have two decimals, each counted ``weight`` times.

    The sum runs over whole hundredths, so it does not depend on the order in which
    tasks deliver their parts.
    """
    weight = F.lit(1) if weight is None else weight
    known = F.when(value.isNotNull(), weight)
    hundredths = F.round(value * 100).cast("bigint")
    return F.sum(hundredths * weight) / F.nullif(F.sum(known) * 100, F.lit(0))


def raw_prr(a: Column, n_drug: Column, n_reac: Column, total: Column) -> Column:
    return _over(_over(a, n_drug), _over(n_reac, total))


def raw_ror(a: Column, n_drug: Column, n_reac: Column, total: Column) -> Column:
    neither = total - n_reac - n_drug + a
    # Doubles before multiplying: the product of two counts can pass 2^63.
    return _over(a.cast("double") * neither, (n_drug - a).cast("double") * (n_reac - a))


def prr(a: Column, n_drug: Column, n_reac: Column, total: Column) -> Column:
    return F.round(raw_prr(a, n_drug, n_reac, total), 3)


def ror(a: Column, n_drug: Column, n_reac: Column, total: Column) -> Column:
    return F.round(raw_ror(a, n_drug, n_reac, total), 3)


def is_signal(a: Column, n_drug: Column, n_reac: Column, total: Column) -> Column:
    strong = raw_prr(a, n_drug, n_reac, total) >= SIGNAL_MIN_PRR
    return F.coalesce((a >= SIGNAL_MIN_REPORTS) & strong, F.lit(False))
