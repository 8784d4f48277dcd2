"""Tables written to the shared folder: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlspark.session import shared_dir


class Scratch:
    """Intermediate tables of one operator call, below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = shared_dir(spark, purpose)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """The frame's rows, written once and read back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
