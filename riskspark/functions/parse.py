"""Locale-tolerant parsing of raw quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The formats that dates are tried in, in this order.
DATE_FORMATS = ("dd.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")


def to_number(s: Column) -> Column:
    """Digits with apostrophes, blanks or either mark as group separators; null where no number results."""
    bare = F.regexp_replace(F.trim(s), "['  ]", "")
    foreign = F.contains(bare, F.lit(",")) & ~bare.rlike(r",\d*\.")
    return F.regexp_replace(F.when(foreign, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare), ",", "").try_cast("double")


def with_dates(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """The column as dates: in the first format that more than `share` of all rows parse in, else each row by its own first format."""
    tried = df.agg(*[F.avg(F.try_to_timestamp(F.col(column), F.lit(f)).isNotNull().cast("int")).alias(f"f{k}") for k, f in enumerate(DATE_FORMATS)]).first()
    best = next((f for k, f in enumerate(DATE_FORMATS) if (tried[k] or 0) > share), None)
    options = [F.to_date(F.try_to_timestamp(F.col(column), F.lit(f))) for f in ([best] if best else DATE_FORMATS)]
    return df.withColumn(column, F.coalesce(*options))


def name(s: Column) -> Column:
    return F.upper(F.trim(s))
