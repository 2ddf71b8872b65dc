"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, tempfile.TemporaryDirectory] = {}
_STAGED: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# Shuffle files go with the job that made them, not with the driver's next full collection.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Settings every intake job relies on; cluster sizing stays with the cluster."""
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used when the setting is absent and the
    master is local, as in tests.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.TemporaryDirectory(prefix="millrace-", ignore_cleanup_errors=True)  # goes with the process
    return _LOCAL_DIRS[app].name


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def _read(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def stage(df: DataFrame, label: str = "stage", folders: Sequence[str] = (), compact: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; each value of ``folders`` gets its own.

    Cuts the lineage, survives lost executors, keeps column pruning for the
    readers, and makes ``count()`` a footer-only read, so sizes can be checked
    before anything is broadcast. ``compact`` is for tables as large as a source:
    they are written with zstd, and the shuffle files of their job go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _STAGED.append(path)
    if compact:
        with _shuffles_dropped(spark):
            df.write.parquet(path, partitionBy=list(folders) or None, compression="zstd")
    else:
        df.write.parquet(path, partitionBy=list(folders) or None)
    return _read(spark, df, path)


def stage_parts(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """The union of ``parts`` by name as one compact staged table. One part is written after another, so that only one's shuffle files are there at a time."""
    union = reduce(DataFrame.unionByName, parts)
    spark = union.sparkSession
    path = scratch_path(spark, label)
    _STAGED.append(path)
    for part in parts:
        with _shuffles_dropped(spark):
            part.select(*[F.col(f.name).cast(f.dataType) for f in union.schema.fields]).write.mode("append").parquet(path, compression="zstd")
    return _read(spark, union, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(staged: DataFrame) -> None:
    """Delete the files of a table that ``stage`` returned, when nothing will read them again."""
    path = _PATHS.pop(staged, None)
    if path is not None:
        _delete(staged.sparkSession, path)


@dataclass
class Steps:
    """Stages one step of a job after another, each in parts; a step goes as soon as the next one is written."""

    label: str
    last: DataFrame | None = None

    def __call__(self, parts: Sequence[DataFrame]) -> DataFrame:
        written = stage_parts(parts, self.label)
        self.done()
        self.last = written
        return written

    def done(self) -> None:
        if self.last is not None:
            discard(self.last)
            self.last = None


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete on leaving what was staged inside; results must have been written by then.

    The function it gives excepts a staged table from that.
    """
    start, spared = len(_STAGED), set()

    def kept(staged: DataFrame) -> DataFrame:
        spared.add(_PATHS[staged])
        return staged

    try:
        yield kept
    finally:
        for path in _STAGED[start:]:
            if path not in spared:
                _delete(spark, path)
        _STAGED[start:] = [path for path in _STAGED[start:] if path in spared]


@dataclass(frozen=True)
class Facts:
    """A staged table with its row count and text volume, taken while it was written."""

    df: DataFrame
    rows: int
    bytes: int

    def renamed(self, old: str, new: str) -> Facts:
        return Facts(self.df.withColumnRenamed(old, new), self.rows, self.bytes)

    def narrowed(self, *columns: str) -> Facts:
        return Facts(self.df.select(*columns), self.rows, self.bytes)


def stage_facts(df: DataFrame, label: str = "facts", compact: bool = False) -> Facts:
    seen = Observation()
    width = F.lit(0)
    for c in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8
    measured = df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
    staged = stage(measured, label, compact=compact)
    return Facts(staged, seen.get["n"], seen.get["bytes"])
