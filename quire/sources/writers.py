"""Sinks: tables for network viewers, property graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import safe_cell

#: Columns of the citation-index export that network viewers read: fixed names.
INDEX_COLUMNS = ["Authors", "Title", "Year", "Source title", "Cited by", "DOI", "Abstract", "Author Keywords", "Index Keywords", "References", "Document Type", "Language of Original Document", "Publication Stage", "Open Access", "EID"]


def index_rows(w: DataFrame) -> DataFrame:
    """Works in the columns of a citation index, lists joined by '; ', missing ones empty, cells safe
    to open in a spreadsheet."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(F.col(c), "; "), F.lit(""))
    cells = {
        "Authors": joined("authors"), "Title": text("title"), "Year": text("year"), "Source title": F.lit(""), "Cited by": F.coalesce(F.col("citations").cast("string"), F.lit("0")),
        "DOI": text("doi"), "Abstract": text("abstract"), "Author Keywords": joined("concepts"), "Index Keywords": F.lit(""), "References": joined("refs"), "Document Type": text("type"),
        "Language of Original Document": text("language"), "Publication Stage": F.lit("Final"), "Open Access": F.when(F.col("is_oa"), "All Open Access").otherwise(""), "EID": text("work"),
    }
    return w.select(*(safe_cell(cells[c]).alias(c) for c in INDEX_COLUMNS))


def plain_properties(df: DataFrame) -> DataFrame:
    """Only columns that a property graph stores: scalars, and arrays of scalars without nulls; NaN as
    null. Others are left out."""
    scalar = lambda t: not isinstance(t, (T.StructType, T.MapType, T.ArrayType, T.VariantType))
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        elif scalar(f.dataType):
            out.append(c)
        elif isinstance(f.dataType, T.ArrayType) and scalar(f.dataType.elementType):
            out.append(F.filter(c, lambda x: x.isNotNull()).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """A folder per value of ``by``, such as a node's label; rows of a value gather in few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One row of JSON per row, with NaN as null."""
    return plain_properties(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def newick(tree, lengths: bool = True) -> str:
    """A tree of (children, length) or (name, length) pairs in Newick form; odd characters of names
    become underscores."""
    import re

    def part(node, top=False):
        what, length = node
        text = f"({','.join(part(c) for c in what)})" if isinstance(what, (list, tuple)) else re.sub(r"[^\w.-]", "_", str(what))
        return text if top or not lengths else f"{text}:{length:.6g}"

    return part(tree, True) + ";"
