"""Tables as files. Parquet is the exact form; text is for exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.clean import instruments
from riskspark.operators.split import Split

from .shared import file_system
from .text import label_and_path, labelled_windows

#: The forms that prices and returns have in text.
PRICE_FORM, RETURN_FORM = "%.8f", "%.8e"


def write_wide(panel: DataFrame, path: str, form: str = PRICE_FORM) -> None:
    """valor, d, value as a wide file in the order of dates, each number in a fixed form; null is blank."""
    names = instruments(panel)
    cells = [F.when(F.col(f"`{n}`").isNotNull(), F.format_string(form, F.col(f"`{n}`"))).alias(str(n)) for n in names]
    wide = panel.groupBy("d").pivot("valor", names).agg(F.first("value"))
    wide.orderBy("d").select(F.date_format("d", "yyyy-MM-dd").alias("Date"), *cells).write.csv(path, header=True)


def write_selection(best: DataFrame, path: str) -> None:
    """The stream chosen for each instrument, for audit."""
    best.select(*[F.col(c).alias(c.upper() if c != "n_obs" else c) for c in ("valor", "price_type", "currency", "n_obs")]).write.csv(path, header=True)


def write_windows(windows: DataFrame, path: str) -> None:
    """label, w, k, j, x with a folder for each label."""
    windows.write.partitionBy("label").parquet(path)


def write_split(spark: SparkSession, split: Split, path: str) -> None:
    """One line of JSON."""
    spark.createDataFrame([(json.dumps(split.stored(), sort_keys=True),)], "value string").write.text(path)


def read_split(spark: SparkSession, path: str) -> Split:
    return Split.restored(json.loads(spark.read.text(path).first()[0]))


def write_generated(windows: DataFrame, split: Split, path: str) -> None:
    """One label's windows with the split that they were made under beside them."""
    windows.write.parquet(f"{path}/windows")
    write_split(windows.sparkSession, split, f"{path}/split")


def read_generated(spark: SparkSession, specs: list[str], rows: int, allow_missing: bool = False) -> tuple[DataFrame, Split | None]:
    """label, w, k, j, x of LABEL=PATH specs that write_generated() wrote, and the one split that all were made under.

    Sources of several splits are an error, and so are sources without one, unless that is allowed, and a split of other data than these rows.
    """
    found: dict[str, Split] = {}
    missing, paths = [], []
    for label, path in map(label_and_path, specs):
        fs, at = file_system(spark, f"{path}/split")
        if fs.exists(at):
            split = read_split(spark, f"{path}/split")
            split.guard(rows)
            found[split.id] = split
        else:
            missing.append(path)
        paths.append(f"{label}={path}/windows")
    if len(found) > 1:
        raise ValueError(f"the sources were made under {len(found)} splits: {', '.join(sorted(found))}")
    if missing and not allow_missing:
        raise ValueError(("no source has" if not found else f"{', '.join(missing)} has no") + " split beside it")
    return labelled_windows(spark, paths), next(iter(found.values()), None)


def write_marginals(ends: DataFrame, knots: DataFrame, path: str) -> None:
    """The two tables of marginals, from which the distribution function can be read back whole."""
    ends.write.parquet(f"{path}/tails")
    knots.write.parquet(f"{path}/body")


def read_marginals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tails"), spark.read.parquet(f"{path}/body")


def write_regime(ranks: DataFrame, reference: DataFrame, path: str) -> None:
    """The rank of volatility of each row, and the earlier volatilities in order that it refers to."""
    ranks.write.parquet(f"{path}/u")
    reference.write.parquet(f"{path}/reference")


def write_report(table: DataFrame, path: str) -> None:
    """A small report as text with a header."""
    table.write.csv(path, header=True)
