"""Column helpers reproducing the reference's JavaScript value semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal as JavaScript's Number() accepts it (signs, '.5', '1.',
# exponents, surrounding blanks). Spark's cast alone would also accept
# '1.5d', 'inf' and 'NaN', which Number() rejects.
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def js_round(x: Column, digits: int = 0) -> Column:
    """Math.round(x * 10^d) / 10^d: half rounds toward +infinity, on the
    binary double (so 1.005 -> 1.0), unlike SQL ROUND."""
    k = 10.0 ** digits
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k) if digits else F.floor(x + F.lit(0.5)).cast("double")


def to_num(v: Column) -> Column:
    """Number(v) for string input: '' or blanks -> 0, decimal text -> double,
    anything else -> NULL. Hex and 'Infinity' are NULL here (deliberate)."""
    s = v.cast("string")
    return (
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(F.trim(s) == "", F.lit(0.0))
        .when(s.rlike(_DECIMAL), F.trim(s).try_cast("double"))
    )


def to_int(v: Column) -> Column:
    """parseInt(v, 10): the leading integer prefix ('12.7' -> 12,
    '12abc' -> 12, '1e3' -> 1), NULL when there is none."""
    digits = F.regexp_extract(v.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


MONEY_DECIMAL = "decimal(38,10)"


def money_sum(c) -> Column:
    """SUM of a money column as an exact decimal, returned as double.

    Floating-point sums depend on the order rows are added, which differs
    with partitioning; a half-cent tie then rounds either way under
    ``js_round``. Summing exactly makes billing figures identical on every
    run and cluster size."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(MONEY_DECIMAL)).cast("double")
