"""Stage tables (SRC7-SRC8): named parquet tables under one root folder
(a shared path on a cluster), no size switch needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stage names, most processed first (chart pages' order).
# Other pages use other orders; ``latest`` takes one.
CHART_ORDER = ["noise_free_dataset", "outlier_free_dataset", "cleaned_dataset", "dataset"]


class StageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> str:
        """SRC7 save: overwrite the named stage (parquet)."""
        p = self.path(name)
        df.write.mode("overwrite").parquet(p)
        return p

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = p.getFileSystem(conf)
        return fs.exists(jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS"))

    def latest(self, order=None) -> str | None:
        """SRC8: first existing stage in ``order`` (default: chart order)."""
        for name in (order or CHART_ORDER):
            if self.exists(name):
                return name
        return None
