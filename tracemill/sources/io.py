"""Scans and sinks: JSON lines, nested JSON, parquet, CSV, Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "content", "name")])
#: Schema of the request log.
REQUEST_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("tool_schemas", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType()))]))),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("cache_bucket", T.StringType()),
        T.StructField("provider_metadata", T.StructType([T.StructField("api_surface", T.StringType()), T.StructField("brokered", T.BooleanType()), T.StructField("stream", T.BooleanType())])),
    ]
)


def read_lines(spark: SparkSession, path: str, schema: T.StructType = REQUEST_LOG) -> DataFrame:
    """JSON lines with a stated schema (no inference pass); blank lines are passed over, folders are read whole."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def stream_lines(spark: SparkSession, path: str, schema: T.StructType = REQUEST_LOG, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def read_any(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None, wrappers: tuple[str, ...] = ("rows", "data", "tasks", "trajectories", "examples")) -> DataFrame:
    """``jsonl``, ``json`` (a list, an object, or rows under a wrapper key), or ``parquet``; with ``_source_file``."""
    if kind == "parquet":
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    elif kind == "jsonl":
        df = spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    elif kind == "json":
        df = spark.read.option("multiLine", "true").json(path)
        key = next((w for w in wrappers if w in df.columns and isinstance(df.schema[w].dataType, T.ArrayType)), None)
        if key:
            df = df.select(F.col("_metadata.file_path").alias("_source_file"), F.explode(key).alias("r")).select("_source_file", "r.*")
            return df
    else:
        raise ValueError(f"unknown kind: {kind}")
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_table(parts: Iterable[DataFrame], path: str) -> None:
    """CSV with the union of the parts' columns as header."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(parts)).write.mode("overwrite").option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small summary as a Markdown table (floats with three digits).

    A report holds at most ``most`` rows; a longer table raises an error and is
    never cut silently.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write a table instead")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def summary_json(df: DataFrame) -> str:
    """A one-row summary as indented JSON."""
    row = df.head()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, sort_keys=True, default=str)


def write_json(df: DataFrame, path: str) -> None:
    """A one-row summary as an indented JSON file."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(summary_json(df) + "\n")


def removed_fields(df: DataFrame) -> DataFrame:
    """``field``, ``n_rows``: the columns that ``provider_view`` drops, and in how many rows each has a value."""
    gone = [c for c in df.columns if c not in REQUEST_LOG.fieldNames()]
    if not gone:
        return df.sparkSession.createDataFrame([], "field string, n_rows bigint")
    counted = df.agg(*[F.count(c).alias(c) for c in gone])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_rows")) for c in gone])).alias("x")).select("x.*")


def provider_view(df: DataFrame) -> DataFrame:
    """The columns that linkage may see; labels and all other columns are dropped, nested metadata too."""
    kept = [c for c in REQUEST_LOG.fieldNames() if c in df.columns]
    out = df.select(*kept)
    if "provider_metadata" in kept:
        allowed = {f.name for f in REQUEST_LOG["provider_metadata"].dataType.fields}
        extra = [f.name for f in df.schema["provider_metadata"].dataType.fields if f.name not in allowed]
        if extra:
            out = out.withColumn("provider_metadata", F.col("provider_metadata").dropFields(*extra))
    return out
