"""Scalar expressions with the missing-value rules of the feature tables.

Missing is SQL NULL everywhere. Sentinels and out-of-range values become NULL, comparisons
with NULL give flag 0, and NaN never leaves a ratio.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def quoted(name: str) -> str:
    """The same in SQL text."""
    return f"`{name.replace('`', '``')}`"


def field(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col(f"`{name}`")


def _c(c: ColumnOrName) -> Column:
    return field(c) if isinstance(c, str) else c


def null_if(c: ColumnOrName, value) -> Column:
    """One sentinel value becomes NULL."""
    return F.nullif(_c(c), F.lit(value))


def null_if_in(c: ColumnOrName, values: Sequence) -> Column:
    """Any of a set of sentinel values becomes NULL."""
    c = _c(c)
    return F.when(~c.isin(*values), c)


def null_below(c: ColumnOrName, threshold) -> Column:
    """Values under the threshold become NULL."""
    c = _c(c)
    return F.when(c >= threshold, c)


def drop_nan(c: ColumnOrName) -> Column:
    """NaN becomes NULL, infinities stay."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def ratio(num: ColumnOrName, den: ColumnOrName, on_zero: str = "ieee") -> Column:
    """Division that never raises.

    ``ieee``: x/0 is signed infinity and 0/0 is NULL. ``null``: any division by zero is NULL.
    """
    num, den = _c(num).cast("double"), _c(den).cast("double")
    if on_zero == "null":
        return F.try_divide(num, den)
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'ieee' or 'null', not {on_zero!r}")
    inf = F.lit(float("inf"))
    by_zero = F.when(num > 0, inf).when(num < 0, -inf)
    return F.when(den == 0, by_zero).otherwise(drop_nan(num / den))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def band_flag(c: ColumnOrName, low, high) -> Column:
    """1 inside the half-open band (low, high], else 0."""
    c = _c(c)
    return flag((c > low) & (c <= high))


def tri_flag(lower: ColumnOrName, upper: ColumnOrName) -> Column:
    """1 if lower < upper, 0 if not, NULL if either is missing."""
    lower, upper = _c(lower), _c(upper)
    return F.when(lower < upper, 1).when(lower >= upper, 0)


def contains_flag(c: ColumnOrName, text: str, null_as: int = 0) -> Column:
    """Case-insensitive literal substring flag; ``null_as`` is the flag of missing text."""
    hit = F.contains(F.lower(_c(c)), F.lit(text.lower()))
    return F.when(hit, 1).when(hit.isNull(), null_as).otherwise(0)


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Elapsed days between two dates; on day offsets use plain subtraction."""
    return F.datediff(_c(end), _c(start))


def weighted_sum(weights: dict[str, float]) -> Column:
    """Linear combination; NULL if any input is NULL."""
    terms = [field(name) * F.lit(weight) for name, weight in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def row_reduce(cols: Sequence[ColumnOrName], fn: str) -> Column:
    """Reduce several columns of one row, skipping NULL; the sum of none is 0."""
    cols = [_c(c).cast("double") for c in cols]
    if fn == "min":
        return F.least(*cols)
    if fn == "max":
        return F.greatest(*cols)
    if fn == "median":
        present = F.sort_array(F.array_compact(F.array(*cols)))
        n = F.size(present)
        lower = F.get(present, F.floor((n - 1) / 2).cast("int"))
        upper = F.get(present, F.floor(n / 2).cast("int"))
        return (lower + upper) / 2
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    if fn == "sum":
        return total
    if fn == "mean":
        return F.try_divide(total, sum((flag(c.isNotNull()) for c in cols[1:]), flag(cols[0].isNotNull())))
    raise ValueError(f"unknown row reduction {fn!r}")


def known_category(c: ColumnOrName, values: Sequence[str]) -> Column:
    """The category itself; a value outside the frozen list fails the job, NULL passes."""
    c = _c(c)
    message = F.concat(F.lit("unknown category: "), c.cast("string"))
    return F.when(c.isNull() | c.isin(*values), c).otherwise(F.raise_error(message))
