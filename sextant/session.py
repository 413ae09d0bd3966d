"""Session factory with the settings that the package's semantics rest on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measured bytes up to which a side of a join is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20

_ROOTS: dict[str, str] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def build_session(app: str = "sextant", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE with skew handling; ``conf`` adds or overrides.

    Partition counts and sizes are left to AQE and to the cluster's defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; only a local
    master, where driver and executors are one process, may leave it unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _ROOTS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sextant-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses; within ``temporary``
    it is deleted at the end."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _SCOPE.get()) is not None:
        held.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what many branches of a
    plan read is made once, and survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables written within it by ``written``. Put the
    call and the writing of its result into this scope, as lazy results still read them."""
    held: list[str] = []
    before = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        unstage(spark, *held)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the written table ``df`` is measured to hold at most
    ``limit`` bytes; else the join is left to shuffle, with AQE splitting skew."""
    if any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
        return df
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.sum(sum(lengths, F.lit(16 * len(df.columns))).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df
