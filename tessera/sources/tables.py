"""Strict readers: declared columns only, as text, with typed views that turn bad values into nulls and counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnMismatch(ValueError):
    """A table does not have exactly the declared columns."""


def normal_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower().lstrip("﻿"))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV file with a header (a byte-order mark is dropped); all columns are strings.

    Quoted fields may hold line breaks, and doubled quotes stand for one. A file is then read by one task; line_breaks=False reads large files
    in parts, where every line is a row.
    """
    df = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return exact_columns(df, columns) if columns else df


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array of objects, or one object a line."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def exact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing, extra = sorted(set(columns) - set(df.columns)), sorted(set(df.columns) - set(columns))
    if missing or extra:
        raise ColumnMismatch(f"missing {missing}, unexpected {extra}")
    return df.select(*columns)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to the given kinds; malformed tells rows where a non-empty value could not be read."""
    bad = F.lit(False)
    out = {}
    for name, kind in kinds.items():
        text = F.trim(F.col(name))
        out[name] = F.when(text != "", text).try_cast(kind)
        bad = bad | (F.coalesce(text != "", F.lit(False)) & out[name].isNull())
    return df.withColumns({**out, "malformed": bad})


def read_lines_strict(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every line of a large CSV; those without the right number of fields keep nulls and their text in corrupt."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("corrupt", T.StringType())])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "corrupt").csv(path)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet that never overwrites."""
    df.write.mode("errorifexists").parquet(path)
