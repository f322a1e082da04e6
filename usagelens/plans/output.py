"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Timestamps back to the inputs' NTZ type; computed doubles rounded so
    sums taken in a different order compare equal. Columns in ``keep`` pass
    stored values through unchanged (rounding those would move some of them
    by one ulp)."""
    cols = []
    for fld in df.schema.fields:
        c = F.col(f"`{fld.name}`")
        if isinstance(fld.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(fld.dataType, T.DoubleType) and fld.name not in keep:
            c = F.round(c, digits)
        cols.append(c.alias(fld.name))
    return df.select(*cols)
