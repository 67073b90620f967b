"""Reading and writing article tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PART = 100_000


def read_csv(spark: SparkSession, path: str, breaks_in_cells: bool = True) -> DataFrame:
    """A CSV file or folder with a header, nulls as empty strings; cells that aren't UTF-8 are read as Latin-1.

    The file is read once, as bytes; each cell is decoded by itself.  Where cells hold line breaks a file is the work of
    one task, so large tables come as folders of parts, or with ``breaks_in_cells`` off, which lets files be split.  An
    empty file is an error, as its columns can't be known.
    """
    df = spark.read.csv(
        path, header=True, encoding="ISO-8859-1", multiLine=breaks_in_cells, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    if not df.columns:
        raise ValueError(f"{path} has no columns")

    def name(c: str) -> str:
        try:
            return c.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return c

    raw = lambda c: F.encode(F.col(f"`{c}`"), "ISO-8859-1").cast("string")
    cells = [F.when(F.is_valid_utf8(raw(c)), raw(c)).otherwise(F.col(f"`{c}`")).alias(name(c)) for c in df.columns]
    return df.select(*cells).na.fill("")


def list_cells(x: str) -> Column:
    """Cells that look like lists (``['a', "b"]``) as arrays, others as arrays of themselves; never evaluated as code."""
    c = F.trim(x)
    inner = F.regexp_replace(F.regexp_replace(c, r"^\[|\]$", ""), r"\s*,\s*(?=['\"])", "\u0001")
    parts = F.filter(F.transform(F.split(inner, "\u0001"), lambda w: F.regexp_replace(F.trim(w), r"^['\"]|['\"]$", "")), lambda w: w != "")
    return F.when(c.rlike(r"(?s)^\[.*\]$"), parts).when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV or JSON file or folder, by its ending; folders of parts are one table."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith((".json", ".ndjson")):
        return spark.read.json(path)
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tables as one, columns by name."""
    out = read_any(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(read_any(spark, p), allowMissingColumns=True)
    return out


def write_parts(df: DataFrame, path: str, rows: int = ROWS_PER_PART, fmt: str = "parquet") -> None:
    """Parts of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).format(fmt).save(path)


def write_tabs(frames: dict[str, DataFrame], path: str) -> None:
    """One folder for each named frame."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def documents(df: DataFrame, columns: list[str], id_col: str | None = None) -> DataFrame:
    """``_id, doc``: rows as JSON of the listed columns, ready for a bulk index of any kind."""
    known = [c for c in columns if c in df.columns]
    key = F.col(id_col).cast("string") if id_col else F.sha2(F.to_json(F.struct(*known)), 256)
    return df.select(key.alias("_id"), F.to_json(F.struct(*known)).alias("doc"))


def index_pattern(df: DataFrame, title: str, time_column: str | None = None, url_columns: dict[str, str] | None = None) -> str:
    """Saved object (JSON) of an index pattern over the columns of ``df``; ``url_columns``: link templates by column."""
    kinds = {"string": "string", "boolean": "boolean", "date": "date"}
    fields = []
    for name, kind in df.dtypes:
        kind = kind.removeprefix("array<").removesuffix(">")
        own = {"name": name, "type": kinds.get(kind, "date" if kind.startswith("timestamp") else "number")}
        if url_columns and name in url_columns:
            own |= {"format": "url", "template": url_columns[name]}
        fields.append(own)
    attributes = {"title": title, "fields": json.dumps(fields)} | ({"timeFieldName": time_column} if time_column else {})
    return json.dumps({"type": "index-pattern", "id": title, "attributes": attributes})


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with their key."""
    kept = base.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def base64_csv(df: DataFrame) -> DataFrame:
    """Each row's CSV line as base64."""
    return df.select(F.base64(F.encode(F.to_csv(F.struct(*df.columns)), "UTF-8")).alias("line"))


def data_bars(df: DataFrame, column: str) -> DataFrame:
    """``column`` with its share of the way from the least to the greatest value."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    bar = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(F.broadcast(ends)).withColumn("bar", bar).drop("_lo", "_hi")


def highlight(column: str, value: str, style: str = "highlight") -> Column:
    return F.when(F.col(column) == value, style)
