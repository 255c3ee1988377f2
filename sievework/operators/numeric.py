"""Numbers of two texts compared as quantities."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Kg to lb, km to miles, m to feet, cm to inches, square km to square miles, ha to acres, l to gallons.
UNIT_RATIOS = (2.20462, 0.621371, 3.28084, 0.393701, 0.386102, 2.47105, 0.264172)


#: (factor, addend, absolute, relative): y is x if it is factor x + addend within one of the bounds.
RULES = [(1.8, 32.0, 1.0, 0.0)] + [(r, 0.0, 0.0, 0.02) for r in UNIT_RATIOS]
#: Those that hold from the second side to the first, too.
BOTH_WAYS = RULES[1:]


def _converted(x: np.ndarray, y: np.ndarray, rules) -> np.ndarray:
    off = [np.abs(factor * x + addend - y) <= np.maximum(absolute, relative * np.abs(y)) for factor, addend, absolute, relative in rules]
    return np.any([o if absolute else o & (y != 0) for o, (_, _, absolute, _) in zip(off, rules)], 0)


def _decade(short: np.ndarray, year: np.ndarray) -> np.ndarray:
    return (short >= 0) & (short <= 99) & (year >= 1000) & (year <= 2100) & (year % 100 == short)


def same_quantities(a, b) -> np.ndarray:
    """For each pair of a and b: one quantity in two units, a decade in two spellings, or Celsius as Fahrenheit."""
    x, y = np.asarray(a, np.float64)[:, None], np.asarray(b, np.float64)[None, :]
    return _converted(x, y, RULES) | _converted(y, x, BOTH_WAYS) | _decade(x, y) | _decade(y, x)


def disagree(a, b) -> bool:
    """Whether both sides keep a number after equal ones and equal quantities have been struck out, in order."""
    left, right = Counter(a), Counter(b)
    same = same_quantities(list((left - right).elements()), list((right - left).elements()))
    free = np.ones(same.shape[1], bool)
    for row in same:
        partner = (row & free).argmax() if free.size else 0
        free[partner : partner + 1] &= not row[partner : partner + 1].any()
    return bool(same.shape[0] > (~free).sum() and free.any())


@F.pandas_udf(BooleanType())
def numbers_disagree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrays of numbers; a null array holds none."""
    none = ()
    return pd.Series([disagree(none if x is None else list(x), none if y is None else list(y)) for x, y in zip(a, b)], dtype=bool)
