"""Session helpers."""

from __future__ import annotations

import contextvars
import tempfile
import threading
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import CancelledError, ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def build_session(app: str = "labelsift", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Cluster sizing (executors, memory, shuffle partitions) is left to ``spark-submit`` unless given;
    AQE coalesces and splits shuffle partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack walk for each column expression
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one up only for a local master without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="labelsift-checkpoint-")
    sc.setCheckpointDir(folder)


_held: contextvars.ContextVar[list | None] = contextvars.ContextVar("held", default=None)


@contextmanager
def released():
    """Frames that ``settle`` persists inside, also in the threads of ``in_parallel``, are given up at the end. Results must have
    been taken by then."""
    held: list = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        for df in held:
            df.unpersist()


def in_parallel(spark: SparkSession, fn: Callable, items: Iterable, parallelism: int, pool: str | None = None) -> list:
    """``fn`` of every item, in order, ``parallelism`` at a time; once one fails, no other is begun. The threads share the
    caller's scope of settled frames. With ``pool`` the n-th item's jobs go to the scheduler pool of that name and number, so that under the FAIR scheduler items share the
    executors evenly instead of waiting for one another; else they stay in the caller's pool.
    """
    sc = spark.sparkContext
    own, failed = sc.getLocalProperty("spark.scheduler.pool"), threading.Event()

    def one(numbered: tuple):
        i, item = numbered
        if failed.is_set():
            raise CancelledError
        sc.setLocalProperty("spark.scheduler.pool", f"{pool}-{i}" if pool else own)
        try:
            return fn(item)
        except BaseException:
            failed.set()
            raise
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    numbered = list(enumerate(items))
    contexts = [contextvars.copy_context() for _ in numbered]
    with ThreadPoolExecutor(max(1, parallelism)) as threads:
        return list(threads.map(lambda c, x: c.run(one, x), contexts, numbered))


def settle(df: DataFrame, how: str = "persist") -> DataFrame:
    """Keep a result that several jobs read.

    ``persist``: cached blocks, recomputed from lineage when an executor is lost.
    ``checkpoint``: written to the shared checkpoint folder, lineage cut; right for expensive inputs
    such as model-scored probabilities, and needed where a recomputation could differ.
    ``none``: rescan each time; right when the input is already a narrow table on disk.
    """
    if how == "none":
        return df
    if how == "persist":
        if df.is_cached:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        if _held.get() is not None:
            _held.get().append(df)
        return df
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    raise ValueError(f"unknown way to settle a frame: {how}")


_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application, whichever thread comes first.

    Needed where vectorised functions run and the package was neither installed on the executors nor
    given to ``spark-submit --py-files``.
    """
    sc = spark.sparkContext
    with _shipping:  # Spark refuses a second file of the same name
        if getattr(sc, "_labelsift_shipped", False):
            return
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="labelsift-")) / "labelsift.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(str(archive))
        sc._labelsift_shipped = True
