"""Column helpers: null-safe arithmetic, ranks, scores, units, names, sessions and lineage."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from pyspark.sql.column import Column as _Column


def col(c: str | Column) -> Column:
    return c if isinstance(c, _Column) else F.col(c)


def ratio(x: str | Column, y: str | Column) -> Column:
    """x / y, NULL where y is zero or either is NULL."""
    return F.try_divide(col(x), F.nullif(col(y), F.lit(0)))


def clip(x: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def change(x: str | Column, before: str | Column) -> Column:
    return ratio(col(x) - col(before), before)


def trailing(by: WindowSpec, n: int, last: int = 0) -> WindowSpec:
    """The last n rows up to ``last`` rows ago."""
    return by.rowsBetween(-(n - 1) - last, -last)


def full(value: Column, counted: Column, frame: WindowSpec, n: int) -> Column:
    """A framed aggregate, NULL unless the frame holds n non-null values."""
    return F.when(F.count(counted).over(frame) >= n, value)


def sma(x: str | Column, by: WindowSpec, n: int) -> Column:
    frame = trailing(by, n)
    return full(F.avg(col(x)).over(frame), col(x), frame, n)


# Ranks. NULLs never take a rank; ties are the minimum or the average rank, as the caller says.


def min_rank(x: str | Column, *keys: str | Column) -> Column:
    by = Window.partitionBy(*keys).orderBy(col(x).asc_nulls_last())
    return F.when(col(x).isNotNull(), F.rank().over(by))


def scaled_rank(x: str | Column, *keys: str | Column, signed: bool = False, single: float | None = None) -> Column:
    """(min rank - 1) / (non-nulls - 1) in [0, 1], or in [-1, 1]; ``single`` where there is one value only."""
    n = F.count(col(x)).over(Window.partitionBy(*keys))
    unit = F.try_divide((min_rank(x, *keys) - 1).cast("double"), F.nullif(n - 1, F.lit(0)))
    unit = unit * 2 - 1 if signed else unit
    return unit if single is None else F.when(col(x).isNotNull(), F.coalesce(unit, F.lit(single)))


def average_rank(x: str | Column, *keys: str | Column) -> Column:
    # ties are counted in the order of the rank itself, so one sort does
    by = Window.partitionBy(*keys).orderBy(col(x).asc_nulls_last())
    ties = F.count(F.lit(1)).over(by.rangeBetween(Window.currentRow, Window.currentRow))
    return min_rank(x, *keys) + (ties - 1) / F.lit(2.0)


def pct_rank(x: str | Column, *keys: str | Column, signed: bool = False) -> Column:
    """Average rank over the number of non-nulls."""
    unit = average_rank(x, *keys) / F.count(col(x)).over(Window.partitionBy(*keys))
    return unit * 2 - 1 if signed else unit


def zscore(x: str | Column, *keys: str | Column, sign: int = 1, flat: float | None = None) -> Column:
    """Distance from the mean in population sigmas; ``flat`` (NULL unless given) where sigma is zero."""
    by = Window.partitionBy(*keys)
    z = F.try_divide((col(x) - F.avg(col(x)).over(by)) * sign, F.nullif(F.stddev_pop(col(x)).over(by), F.lit(0.0)))
    return z if flat is None else F.when(col(x).isNotNull(), F.coalesce(z, F.lit(flat)))


def quintile(x: str | Column, *keys: str | Column, least: int = 5) -> Column:
    """least(5, ceil(5 * cume_dist)), only where there are ``least`` distinct values."""
    by = Window.partitionBy(*keys)
    up, down = by.orderBy(col(x).asc_nulls_last()), by.orderBy(col(x).desc_nulls_last())
    cume = F.cume_dist().over(up)
    # places from both ends count the distinct values; a set of them would go with every row
    distinct = F.dense_rank().over(up) + F.dense_rank().over(down) - 1
    return F.when(col(x).isNotNull() & (distinct >= least), F.least(F.lit(5), F.ceil(cume * 5)))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate; NULL where a side is constant. Rows with a NULL on either side don't count."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))


def erfc(x: Column) -> Column:
    """Complementary error function by a Chebyshev-fitted exponential; relative error below 1.2e-7."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    #: Coefficients of the fit, constant term first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = functools.reduce(lambda acc, c: acc * t + c, reversed(terms[:-1]), F.lit(terms[-1]))
    positive = t * F.exp(-z * z + poly)
    return F.when(x >= 0, positive).otherwise(F.lit(2.0) - positive)


def normal_p_value(mean: Column, sd: Column, n: Column) -> Column:
    """Two-sided p of a mean; 0 where sd is zero and the mean isn't, NULL with fewer than two values."""
    z = F.try_divide(F.abs(mean) * F.sqrt(n.cast("double")), F.nullif(sd, F.lit(0.0)))
    return F.when(n >= 2, F.coalesce(erfc(z / math.sqrt(2)), F.when(mean != 0, 0.0).otherwise(1.0)))


def weighted_mean(*pairs: tuple[Column, float]) -> Column:
    """Mean of the values that are there, weights renormalised over them; NULL if none is."""
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in pairs])
    weight = functools.reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in pairs])
    return ratio(total, weight)


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def close_enough(a: str | Column, b: str | Column, absolute: float, relative: float = 1e-9) -> Column:
    """Equal within the larger of an absolute and a relative tolerance; NULLs equal each other only."""
    a, b = col(a), col(b)
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


#: Factors of unit names.
UNITS = {"SHARES": 1.0, "LOTS": 100.0, "YUAN": 1.0, "THOUSAND": 1000.0, "TEN_THOUSAND": 10000.0, "RATIO": 1.0, "PERCENT": 0.01}


def in_base_units(value: str | Column, unit: str | Column, default: str | Column | None = None) -> Column:
    """The value times its unit's factor, by the default unit where none is named; NULL for unknown units."""
    named = F.upper(F.coalesce(col(unit), col(default) if default is not None else F.lit(None).cast("string")))
    factor = functools.reduce(lambda w, u: w.when(named == u, F.lit(UNITS[u])), list(UNITS)[1:], F.when(named == "SHARES", F.lit(1.0)))
    return col(value).cast("double") * factor


def symbol_parts(code: str | Column) -> tuple[Column, Column, Column]:
    """(six digits, exchange, board) of a code that may carry a prefix or suffix; exchange and board NULL if it has no six digits."""
    digits = F.nullif(F.regexp_extract(F.upper(col(code)), r"(\d{6})", 1), F.lit(""))
    exchange = F.when(digits.rlike("^(6|9)"), "SH").when(digits.rlike("^(0|2|3)"), "SZ").when(digits.rlike("^(4|8)"), "BJ")
    board = F.when(digits.startswith("688"), "STAR").when(digits.startswith("30"), "CHINEXT").when(digits.rlike("^(4|8)"), "BSE").when(digits.isNotNull(), "MAIN")
    return digits, exchange, board


def session_of(minute: str | Column, trading_day: str | Column) -> Column:
    """PRE_MARKET, IN_SESSION, POST_MARKET by 'HH:mm', NON_TRADING_DAY, or UNKNOWN without a time."""
    m = col(minute)
    return F.when(m.isNull() | col(trading_day).isNull(), "UNKNOWN").when(~col(trading_day), "NON_TRADING_DAY").when(m < "09:30", "PRE_MARKET").when(m <= "15:00", "IN_SESSION").otherwise("POST_MARKET")


def row_hash(*columns: str | Column, digits: int = 6) -> Column:
    """SHA-256 over the columns' texts with a separator; NULL has a text of its own. Doubles must come in formatted."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("NULL")) for c in columns]), 256)


def normalised_text(text: str | Column) -> Column:
    """Lower case, full-width ASCII folded, anything but letters, digits and underscores dropped."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))
    return F.regexp_replace(F.lower(F.translate(col(text), wide, narrow)), r"[^\p{L}\p{N}_]", "")


def bigrams(text: str | Column) -> Column:
    t = col(text)
    return F.when(F.length(t) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all distinct items of two arrays; NULL if both are empty."""
    return ratio(F.size(F.array_intersect(col(a), col(b))).cast("double"), F.size(F.array_union(col(a), col(b))))
