"""A compiled corpus: a folder of Parquet tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.schemas import TABLES


class Store:
    """Tables below a folder; one that isn't there is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def read(self, name: str) -> DataFrame:
        schema = TABLES[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table; columns are cast to its schema, those that are missing are null."""
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        df.select(columns).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in TABLES}

    def meta(self, key: str) -> str | None:
        row = self.read("meta").filter(F.col("key") == key).select("value").first()
        return row.value if row else None

    def copy_to(self, folder: str) -> Store:
        """All tables into another folder; refused if that holds a corpus about another paper."""
        other = Store(self.spark, folder)
        mine, theirs = self.meta("target_paper_id"), other.meta("target_paper_id")
        if theirs is not None and theirs != mine:
            raise ValueError(f"{folder} is about {theirs}, not {mine}")
        for name in TABLES:
            if self.exists(name):
                other.write(name, self.read(name))
        return other


def keep_ir(ir: DataFrame, folder: str, version: str) -> None:
    """Parsed documents beside those of other parser versions."""
    ir.withColumn("parser_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parser_version").parquet(folder)


def kept_ir(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Documents that this parser version has parsed; the scan reads its partition alone."""
    return spark.read.parquet(folder).filter(F.col("parser_version") == version).drop("parser_version")
