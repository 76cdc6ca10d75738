"""Session-level helpers: table loading, checked broadcasts, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Upper bound on rows we are willing to ship to every executor.  Anything
# larger is joined by shuffle; the check is a bounded `limit(n + 1).count()`.
BROADCAST_MAX_ROWS = 100_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Session for tests and the bench.  On a cluster the caller owns the session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster setting ``spark.checkpoint.dir`` wins; only when it is unset
    on a ``local[...]`` master (tests) do we pick a fresh scratch folder of
    our own.  On a cluster an unset folder is an error, never a local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # A machine-local folder would not survive the loss of that machine.
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most n + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a proven row bound; otherwise plain shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back (survives executor loss).

    A checkpoint would keep the size that its plan was estimated at.  A join's estimate is the
    product of its sides', so in a loop it becomes a number of millions of digits, which fills the
    driver; a written table has the size of its files.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
