"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(app: str = "lapsewise", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")  # long texts: keep batches small
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lapsewise-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


# A table of at most this many bytes is sent to every executor; a larger one is joined by shuffle.
SMALL_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 for itself, 16 per flat column, and what strings and arrays hold."""
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return size


def is_small(done: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the rows of a computed table take at most ``limit`` bytes."""
    return (done.agg(F.sum(_row_bytes(done))).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Compute a table that should be small, sum its bytes, and mark it for broadcast only when it is."""
    done = settle(df)
    return F.broadcast(done) if is_small(done, limit) else done
