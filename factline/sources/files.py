"""CSV, manifests, pinned files, snapshots and trace logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_SCHEMA = (
    "trace_id bigint, span_id bigint, parent_id bigint, kind string, name string, "
    "started_at timestamp_ntz, value double"
)


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column text. A file that is not there is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        return spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def source_dates(spark: SparkSession, manifests: Mapping[str, str]) -> DataFrame:
    """Source and the day it was read, from each source's manifest.

    A source whose manifest is missing or carries no time is left out: its rows date
    themselves or stay undated.
    """
    out = spark.createDataFrame([], "source string, scraped string")
    for source, path in manifests.items():
        try:
            df = spark.read.schema("scraped_at string").json(path, multiLine=True)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        day = F.to_date(F.try_to_timestamp(F.nullif("scraped_at", F.lit(""))))
        out = out.unionByName(
            df.select(F.lit(source).alias("source"), day.cast("string").alias("scraped")).where(
                "scraped is not null"
            )
        )
    return out


def verify_pinned(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against the sizes and hashes pinned for them; `reason` is null for those accepted.

    files (path, content binary), manifest (path, size, sha256).
    """
    facts = files.select(
        "path",
        F.octet_length("content").cast("bigint").alias("found_size"),
        F.sha2("content", 256).alias("found_sha"),
    )
    reason = (
        F.when(F.col("size").isNull(), "not_pinned")
        .when(F.col("found_size") != F.col("size"), "size_mismatch")
        .when(F.col("found_sha") != F.col("sha256"), "hash_mismatch")
    )
    return facts.join(manifest, "path", "left").select("path", "found_size", reason.alias("reason"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def append_traces(spans: DataFrame, path: str) -> None:
    spans.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(TRACE_SCHEMA).json(path)
