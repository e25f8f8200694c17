"""Session settings and the scratch folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(app: str = "ocrspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings every query of the engine needs, whoever made the session.

    - Spark 4.1 may take a union of equally partitioned inputs for partitioned itself and
      leave out the shuffle before a following aggregate or window. With adaptive plans
      the rows of one key then still sit in several partitions (seen in 4.1.2: a window
      split in two), so that shortcut is off.
    - HotSpot does not compile methods above 8000 bytes of bytecode. A stage that explodes
      twice and computes many columns exceeds that and would run interpreted; with the
      limit known Spark runs such a stage operator by operator, each compiled.
    - A file counts as 4 MB more than it has when files are dealt to tasks, so of a folder with a file for
      each document a task gets few, and a large folder makes more tasks than the driver can start in time.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "256k")
    return spark


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Only sides whose size has been measured at run time are broadcast.

    A size estimate does not see how many rows an explode makes of a document, so a side that
    is thought to be small may be most of the corpus.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "16m")
    return spark


#: Fallback folder of each local application without ``spark.checkpoint.dir``, and the open scopes.
_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def scratch_dir(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage; only a local session falls back to a
    folder of this machine, one for each application. The innermost :func:`scratch_scope` removes
    the folder unless ``keep`` is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ocrspark-")
        root = _LOCAL_ROOTS[app]
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the scratch folders made inside, once the results that need them are written.

    DataFrames made inside read those folders, so they must not be used after the scope.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        sc = spark.sparkContext
        for path in made:
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


#: Stored bytes of texts that a task gets at most: about half a million words.
SPREAD_BYTES = 2 << 20


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``, whatever store it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def spread_parts(spark: SparkSession, size: int = 0) -> int:
    """Partitions that :func:`spread` makes of ``size`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SPREAD_BYTES))


def spread(df: DataFrame, key: str, size: int = 0) -> DataFrame:
    """Deal rows by ``key`` over all shuffle partitions, or over more if ``size`` bytes ask for it.

    Rows of very different cost, such as texts that are cut into words next, then do not
    follow the splits of the files they come from. The number of partitions grows with the input, so a
    task sorts and groups what it gets in memory at every size.
    """
    return df.repartition(spread_parts(df.sparkSession, size), key)


def by_parts(spark: SparkSession) -> SparkSession:
    """Joins take rows that are dealt by some of their keys as they are.

    Spark otherwise shuffles both sides again by all keys. Words of a document come out of one row,
    so they are in one task already, and joins, groups and ranks within pages move no words.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back, for a small result that is used often."""
    path = scratch_dir(df.sparkSession, label, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes on disk up to which a written side of a join is sent to all tasks; in memory it may be ten times as large.
SMALL_SIDE = 2 << 20


def small_side(df: DataFrame, label: str, limit: int = SMALL_SIDE) -> DataFrame:
    """``df`` written once, and marked for broadcast if what was written is small.

    The size is that of the files, not an estimate. Beyond ``limit`` the join is left to Spark,
    which then shuffles both sides; the rows are the same. Runs a job when it is called.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(written) if file_bytes(spark, path) <= limit else written


def stack(first: DataFrame, *rest: DataFrame, missing: bool = False) -> DataFrame:
    """Union by name, safe to aggregate afterwards (see :func:`tune`)."""
    tune(first.sparkSession)
    out = first
    for other in rest:
        out = out.unionByName(other, allowMissingColumns=missing)
    return out
