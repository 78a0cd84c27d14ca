"""What every operator needs from the session: tables, lineage cuts, checked broadcasts, scratch column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def session(cpus: str = "8", name: str = "arbora", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory. Timestamps without zone mean UTC and are read as instants."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables of this application are written: a folder of its own under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session; on a cluster, whose machines do not share one, that
    is an error. The folder goes when the application ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        set_by_hand = sc._jsc.sc().getCheckpointDir()
        base = set_by_hand.get() if set_by_hand.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="arbora-")
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/arbora-{sc.applicationId}"
    path, files = _hadoop_path(spark, folder)
    files.deleteOnExit(path)
    return folder


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _hadoop_path(spark, folder)
    return files.exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder without those that are not data; none if there is no such folder."""
    path, files = _hadoop_path(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(n for n in names if not n.startswith((".", "_")) or "=" in n)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy; with ``by`` in a folder for each value of that column, so that
    readers of one value read no other.

    Lineage ends there, so lost executors do not matter, and the planner sees the size of the files: a frame cut again
    and again in a loop never carries over the product of earlier estimates, as ``checkpoint`` lets it.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(folder)
    return _stored(spark, df.schema, [folder])


def _stored(spark: SparkSession, schema, folders: list[str]) -> DataFrame:
    copy = spark.read.schema(schema).parquet(*folders)
    copy._folders = folders
    return copy


def stacked(frames: list[DataFrame]) -> DataFrame:
    """The rows of several frames of one schema that ``cut`` gave, as one scan, however many they are."""
    return _stored(frames[0].sparkSession, frames[0].schema, [folder for f in frames for folder in f._folders])


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` gave; nothing may read them any more."""
    for frame in frames:
        for folder in frame._folders:
            path, files = _hadoop_path(frame.sparkSession, folder)
            files.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows (counted, no guess), else leave the choice to the planner.

    Counting stops at ``rows`` + 1, so the check itself stays cheap; ``df`` should be cheap to evaluate or already cut.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group in column ``name``, without sorting a group in one task.

    Rows are spread by ranges of (group, order), which cut a large group into pieces, and each piece adds what stands
    before it. ``order`` should leave no ties; null groups are groups.
    """
    both = df.withColumn(name, F.lit(0))
    part, piece, before = scratch(both, "part"), scratch(both, "piece"), scratch(both, "before")
    # Cut, so that both readings see the same ranges.
    placed = cut(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)))
    counts = placed.groupBy(*group, part).agg(F.count("*").alias(piece))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate([*group, part])]
    offsets = counts.select(*keys, F.coalesce(F.sum(piece).over(earlier), F.lit(0)).alias(before))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*group, part])]
    return inside.join(offsets, same).select(*df.columns, (F.col(before) + F.col(name)).alias(name))


def scratch(df: DataFrame, name: str) -> str:
    """``name`` or, if ``df`` has such a column in any case, the name with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_of(df: DataFrame) -> int:
    """Row count from a column-free scan."""
    return df.select().count()


def clean_text(column):
    """Lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
