"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpuscle", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on and UTC time.  Sizes are left to the cluster unless given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a cluster a missing
    setting is an error, because executors could not read one another's local files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    path = tempfile.mkdtemp(prefix="corpuscle-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_WRITTEN: dict[str, list[tuple[str, str | None]]] = {}


def drop_written(spark: SparkSession, keep: int = 0) -> int:
    """Remove what ``written`` left since the first ``keep`` results, files and tables; how many that were.

    For long-lived sessions: note ``len(written_paths(spark))`` before a batch and drop the rest after its
    result was stored.  DataFrames that read a dropped result can't be used any more.
    """
    mine = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    gone, mine[keep:] = mine[keep:], []
    for path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(gone)


def written_paths(spark: SparkSession) -> list[str]:
    return [path for path, _ in _WRITTEN.get(spark.sparkContext.applicationId, [])]


def written(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None,
            already_placed: bool = False, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times or a loop would grow its lineage; the copy outlives
    a lost executor.  ``bucket_by`` keeps rows placed by that column, so later grouping or joining on
    it needs no exchange; ``already_placed`` says that the rows already lie that way, in as many
    partitions, and ``sort_by`` orders the rows of each file.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{tag}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((path, f"{name}_{tag}" if bucket_by else None))
    if bucket_by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    view = f"{name}_{tag}"
    placed = df if already_placed else df.repartition(n, bucket_by)
    out = placed.write.option("compression", "zstd").bucketBy(n, bucket_by)
    (out.sortBy(*sort_by) if sort_by else out).option("path", path).saveAsTable(view)
    return spark.table(view)
