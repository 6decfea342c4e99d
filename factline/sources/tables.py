"""Access to a directory of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    A table in a few small files would leave row-by-row text work to a few tasks. A table of
    many files already has more partitions than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Tables:
    """`Tables(spark, dir).orders` reads `dir/orders.parquet`, lazily."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = str(path).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @property
    def part(self) -> DataFrame:
        return self.table("part")

    @property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @property
    def region(self) -> DataFrame:
        return self.table("region")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"))

    @property
    def benchmark(self) -> DataFrame:
        return self.table("benchmark")

    @property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @property
    def conversations(self) -> DataFrame:
        return self.table("conversations")
