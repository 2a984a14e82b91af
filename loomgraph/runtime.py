"""Session defaults, the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which ``spread`` deals a table out anew, and bytes of files in one piece of ``dealt``.
SMALL, PIECE = 64 << 20, 8 << 20
_WRITTEN: dict[str, list[str]] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults the library is written for."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(master).appName("loomgraph")
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    env["MALLOC_ARENA_MAX"] = "1"  # workers give back what they freed
    env["ARROW_DEFAULT_MEMORY_POOL"] = "system"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # a written table needs no shuffle files
    return spark


def valid(text: Column | str) -> Column:
    """A string column with each byte sequence that is not UTF-8 replaced by U+FFFD, so that Python workers can read it."""
    return F.make_valid_utf8(F.col(text) if isinstance(text, str) else text)


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from files, dealt out to all cores if it is small and has fewer files than there are cores: a file of
    ``SMALL`` bytes may be a single row group, which one task would read alone. Larger tables are left as their files
    are cut."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df


def pieces_of(df: DataFrame) -> int:
    """How many pieces of about ``PIECE`` bytes of its files ``df`` has, one for each core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, read from files, shuffled by ``keys`` into pieces of about ``PIECE`` bytes of its files, one for each core at
    least: what a task groups stays as large when the table grows, whatever the session's number of partitions."""
    return df.repartition(pieces_of(df), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages depend on files that
    outlive any executor, and read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, folder: str) -> None:
    """Let ``sweep`` delete a folder that was not written by ``materialize``."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)


def written(spark: SparkSession) -> int:
    """How many folders ``sweep`` would delete now."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete every table that ``materialize`` wrote in this application (after the first ``since`` ones, and without
    those that ``keep`` was read from). Results are lazy and read such tables: call it once they are written or collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = {os.path.basename(os.path.dirname(f)) for df in keep for f in df.inputFiles()}
    folders = _WRITTEN.get(spark.sparkContext.applicationId, [])
    left = folders[:since] + [f for f in folders[since:] if os.path.basename(f) in kept]
    for folder in folders[since:]:
        if folder not in left:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    _WRITTEN[spark.sparkContext.applicationId] = left


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
