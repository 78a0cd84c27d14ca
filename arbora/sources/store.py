"""The tables of a graph store under one folder, created with their schemas and checked against them on every write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arbora.runtime import children, exists
from arbora.sources import model

TABLES = {
    "users": model.USERS,
    "edges": model.EDGES,
    "user_profiles": model.PROFILES,
    "edge_history": model.HISTORY,
    "crawl_state": model.CRAWL_STATE,
    "config": model.CONFIG,
}


class Store:
    """Opening creates what is missing, as often as it is called. A table is the newest complete version in its folder, so a
    write that fails, or one that reads the table it replaces, does no harm."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        for name, schema in TABLES.items():
            if self._version(name) is None:
                self.replace(name, spark.createDataFrame([], StructType.fromDDL(schema)))

    def _version(self, name: str) -> str | None:
        done = [v for v in children(self.spark, f"{self.root}/{name}") if exists(self.spark, f"{self.root}/{name}/{v}/_SUCCESS")]
        return max(done, default=None)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(TABLES[name])).parquet(f"{self.root}/{name}/{self._version(name)}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Write the next version: columns by name in the table's types. A missing column is null if it may be; a null where
        none may be fails the write."""
        schema = StructType.fromDDL(TABLES[name])
        columns = []
        for f in schema.fields:
            if f.name not in df.columns and not f.nullable:
                raise ValueError(f"{name} needs a column {f.name}")
            value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
            columns.append((value if f.nullable else F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{name}.{f.name} is null")).cast(f.dataType))).alias(f.name))
        last = self._version(name)
        number = int(last.split("-")[0]) + 1 if last else 0
        df.select(*columns).write.parquet(f"{self.root}/{name}/{number:012}-{uuid.uuid4().hex}")
