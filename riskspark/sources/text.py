"""Text files as tables: quote extracts, dated wide panels, numeric matrices, lists, arrays of windows.

A path is whatever Spark's readers take: a file, a folder of part files or a pattern, local or remote.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions import parse

#: The separators that are looked for, the first of equals wins; and the columns of a quote extract.
SEPARATORS = (";", "\t", "|", ",")
QUOTE_COLUMNS = ("VALOR", "FI_ID", "PRICE_TYPE", "PRICE_DATE", "PRICE", "CURRENCY")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    line = spark.read.option("encoding", encoding).text(path).first()
    return line[0].lstrip("﻿") if line else ""


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The separator that the first line has most of; no other line is read."""
    head = first_line(spark, path, encoding)
    return max(SEPARATORS, key=head.count)


def scan_quotes(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The six columns of a quote extract as strings. Names in the header may differ in case, blanks and signs; a missing one is an error."""
    raw = spark.read.csv(path, sep=separator or sniff_separator(spark, path, encoding), header=True, encoding=encoding, ignoreLeadingWhiteSpace=True)
    names = [re.sub("[^A-Z_]", "", c.upper()) for c in raw.columns]
    missing = sorted(set(QUOTE_COLUMNS) - set(names))
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.toDF(*names).select(*QUOTE_COLUMNS)


def typed_quotes(raw: DataFrame) -> DataFrame:
    """valor, fi_id, price_type, currency, d, price out of scan_quotes(); what can't be read is null."""
    dated = parse.with_dates(raw.withColumn("PRICE_DATE", F.trim("PRICE_DATE")), "PRICE_DATE")
    text = [parse.name(F.col(c)).alias(c.lower()) for c in ("VALOR", "FI_ID", "PRICE_TYPE", "CURRENCY")]
    return dated.select(*text, F.col("PRICE_DATE").alias("d"), parse.to_number(F.col("PRICE")).alias("price"))


def dated_panel(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """valor, d, value out of a wide file: dates in the first column, an instrument in each other; blanks are null."""
    raw = spark.read.csv(path, sep=separator, header=True)
    day, *names = raw.columns
    long = raw.unpivot([F.col(quoted(day)).alias("_d")], [F.col(quoted(c)) for c in names], "valor", "_x")
    return long.select("valor", F.to_date("_d").alias("d"), F.expr("try_cast(_x AS DOUBLE)").alias("value"))


def panel_dates(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """d: the first column alone; the reader parses no other."""
    raw = spark.read.csv(path, sep=separator, header=True)
    return raw.select(F.to_date(F.col(quoted(raw.columns[0]))).alias("d"))


def has_header(spark: SparkSession, line: str, separator: str = ",") -> bool:
    """Whether a line has an entry, other than a blank, that is no number."""
    entries = F.split(F.lit(line), re.escape(separator))
    return spark.range(1).select(F.exists(entries, lambda t: (F.trim(t) != "") & F.trim(t).try_cast("double").isNull())).first()[0]


def numeric_matrix(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, list[str]]:
    """The cells t, j, x of a matrix with or without a header, and the names of its columns.

    A column counts if each of its cells is a number or blank; blanks are null. Rows are numbered in the order of files and of lines in them,
    by adding up the row counts of the pieces that Spark reads: no task sees more than its piece. The matrix is never turned.
    """
    line = first_line(spark, path)
    header = has_header(spark, line, separator)
    raw = spark.read.csv(path, sep=separator, header=header)
    columns = [F.trim(F.col(quoted(c))) for c in raw.columns]
    strange = [F.count_if((c != "") & c.try_cast("double").isNull()).alias(f"c{k}") for k, c in enumerate(columns)]
    found = raw.agg(*strange).first()
    keep = [k for k in range(len(columns)) if not found[k]]
    rows = raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
        F.array(*[columns[k].try_cast("double") for k in keep]).alias("_x"),
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # one row for each piece of a file
    pieces = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    cells = rows.join(pieces, ["_file", "_block"]).select((F.col("_start") + F.col("_id") - F.col("_first")).alias("t"), F.posexplode("_x").alias("j", "x"))
    titles = [t for t in (c.strip() for c in raw.columns) if t.casefold() != "date"] if header else []
    return cells, titles if len(titles) == len(keep) else [f"feat{k}" for k in range(len(keep))]


def matrix_returns(cells: DataFrame) -> DataFrame:
    """Prices as log returns; the first row has none and rows are numbered anew."""
    step = F.ln(F.col("x") / F.lag("x").over(Window.partitionBy("j").orderBy("t")))
    return cells.withColumn("x", step).where("t > 0").withColumn("t", F.col("t") - 1)


def require_finite(cells: DataFrame) -> DataFrame:
    """The cells as they are, if all are finite; else an error that says how many are not and how many rows are whole."""
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    each = cells.groupBy("t").agg(F.count_if(bad).alias("bad"))
    n = each.agg(F.sum("bad").alias("bad"), F.count_if(F.col("bad") == 0).alias("whole"), F.count("*").alias("rows")).first()
    if n["bad"]:
        raise ValueError(f"{n['bad']} cells are missing or not finite; {n['whole']} of {n['rows']} rows are whole")
    return cells


def listed_names(spark: SparkSession, path: str) -> DataFrame:
    """valor: one name a line; what follows a # is a remark."""
    name = F.trim(F.element_at(F.split("value", "#"), 1))
    return spark.read.text(path).select(name.alias("valor")).where("valor <> ''")


def label_and_path(spec: str) -> tuple[str, str]:
    """LABEL=PATH, or PATH alone: then generated windows are called after their folder, other files after themselves without a leading gen_."""
    label, _, path = spec.rpartition("=")
    if not path:
        raise ValueError(f"{spec} names no path")
    folder, _, file = path.rstrip("/").rpartition("/")
    stem = file.rpartition(".")[0] or file
    return label or (folder.rpartition("/")[2] if stem == "generated_windows" else stem.removeprefix("gen_")), path


def labelled_windows(spark: SparkSession, specs: list[str]) -> DataFrame:
    """label, w, k, j, x out of Parquet tables of windows, one for each spec."""
    tables = None
    for label, path in map(label_and_path, specs):
        one = spark.read.parquet(path).select(F.lit(label).alias("label"), "w", "k", "j", "x")
        tables = one if tables is None else tables.unionByName(one)
    if tables is None:
        raise ValueError("no windows are named")
    return tables


def array_windows(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """file, w, k, j, x out of .npy files of two dimensions (one window) or three. A file is read by one task, so longer ones than most_bytes are refused."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > most_bytes).select("path").first()
    if large:
        raise ValueError(f"{large[0]} is longer than {most_bytes} bytes; store such windows as Parquet")

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim not in (2, 3):
                    raise ValueError(f"{name} has {a.ndim} dimensions")
                a = a[None] if a.ndim == 2 else a
                for w in range(a.shape[0]):
                    k, j = np.indices(a.shape[1:])
                    yield pd.DataFrame({"file": name, "w": w, "k": k.ravel(), "j": j.ravel(), "x": a[w].astype(float).ravel()})

    return files.select("path", "content").mapInPandas(unpacked, "file string, w long, k int, j int, x double")


def fingerprint(table: DataFrame) -> str:
    """Twelve hex digits that depend on the rows of a table, whatever their order: digests of rows are added up, so no task holds more than sums."""
    row = F.to_json(F.struct(*[F.col(quoted(c)) for c in sorted(table.columns)]), {"ignoreNullFields": "false"})
    part = lambda k: F.sum(F.conv(F.substring(F.sha1(row), k, 12), 16, 10).cast("decimal(38,0)"))
    n, a, b = table.agg(F.count("*"), part(1), part(13)).first()
    return table.sparkSession.range(1).select(F.substring(F.sha1(F.lit(f"{n}:{a}:{b}")), 1, 12)).first()[0]
