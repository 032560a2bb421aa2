"""Sources: delimited, JSON and vector files as DataFrames with explicit schemas.

Schemas are given, never inferred, so that no file is read twice; malformed rows are dropped or kept
in a column where a reader says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import one_blank
from quire.operators.relational import latest


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, separator: str = ",") -> DataFrame:
    """A delimited table with a header; malformed rows and those without a required value are dropped."""
    df = spark.read.csv(path, schema=schema, header=True, sep=separator, mode="DROPMALFORMED")
    return df.dropna(subset=required) if required else df


def read_matrix(spark: SparkSession, path: str, columns: list[str], index: str = "cluster") -> DataFrame:
    """(a, b, value) of the upper triangle of a wide square matrix with an index column; its columns
    are named like the index values."""
    schema = f"`{index}` string, " + ", ".join(f"`{c}` double" for c in columns)
    long = spark.read.csv(path, schema=schema, header=True).unpivot(index, columns, "b", "value")
    return long.select(F.col(index).alias("a"), "b", "value").where("a < b and value is not null")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of nested records in one file or several; records of another type are null rows
    and dropped."""
    df = spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE")
    return df.dropna(how="all")


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A log of JSON lines of which the last line of a key counts; unreadable lines are skipped. Lines
    are ordered by file and place, as the reader gives them within a file."""
    bad = "_corrupt_record"
    fields = [f.name for f in T._parse_datatype_string(schema).fields]
    df = spark.read.json(path, schema=f"{schema}, {bad} string", mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    numbered = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_line", F.monotonically_increasing_id())
    good = numbered.where(F.col(bad).isNull() & F.col(key).isNotNull()).drop(bad)
    return latest(good, key, ["_file", "_line"]).select(fields)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, JSON array, JSON lines or Parquet, by the path's suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix == "json":
        return read_records(spark, path, schema)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def read_by_folder(spark: SparkSession, glob: str, schema: str, name: str = "cluster") -> DataFrame:
    """All CSV files of a glob, with the name of each file's folder."""
    part = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return spark.read.csv(glob, schema=schema, header=True).select("*", F.url_decode(part).alias(name))


def coerced_list(c: Column | str) -> Column:
    """A list out of text: a JSON or literal list, lines, items between pipes, or one item; null gives
    an empty list."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    literal = F.from_json(F.regexp_replace(t, "'", '"'), "array<string>")
    items = (
        F.when(t.startswith("[") & literal.isNotNull(), literal)
        .when(t.contains("\n"), F.split(t, "\n"))
        .when(t.contains("|"), F.split(t, r"\|"))
        .otherwise(F.array(t))
    )
    return F.coalesce(F.filter(F.transform(items, one_blank), lambda x: x != ""), F.array().cast("array<string>"))


def coalesced(df: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """(key, value, origin): each key's value from the first source, in order, that has one."""
    out = df.select(key).distinct()
    for name, s in sources:
        one = s.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_{name}"))
        out = out.join(one, key, "left")
    names = [n for n, _ in sources]
    return out.select(key, F.coalesce(*(F.col(f"_{n}") for n in names)).alias(value), F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), n) for n in names)).alias("origin"))


def filled_up(first: DataFrame, second: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows: half of them from the first source, the rest from the second, none twice,
    by key."""
    a = first.orderBy(key).limit(n // 2)
    b = second.join(a.select(key), key, "left_anti").orderBy(key)
    room = n - a.count()  # at most n
    return a.unionByName(b.limit(room))
