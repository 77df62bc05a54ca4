"""What the training-data operators share: the folder that all machines see,
tables written there to cut lineage, and salts for hot keys."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import threading
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters, for translate().
SPACES = " \t\n\x0b\x0c\r"

#: Has a finished query's shuffle files deleted at once instead of when the JVM happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = threading.Lock()
#: By session: how many tables it is writing, and what CLEANUP was before.
_WRITING: dict[int, tuple[int, str | None]] = {}

# Functions of this package travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session, or what was given to setCheckpointDir. Only a local session
    without either gets a temporary folder, removed at exit."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = tempfile.mkdtemp(prefix="weirflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage
    with files that survive the loss of any executor. Once the table is written
    nothing reads what was shuffled for it, so Spark is asked to delete that."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """CLEANUP for the session; with several threads, until the last of them is done."""
    with _LOCK:
        n, before = _WRITING.get(id(spark), (0, None))
        if not n:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(id(spark))
            if n > 1:
                _WRITING[id(spark)] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def discard(made: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    path = getattr(made, "_stored_at", None)
    if path is not None:
        jvm = made.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(made.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release() -> None:
    """Give back what a task no longer needs: worker processes live on, and the
    next stage's workers share the machine with them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def salts(rows: int, per_group: int = 512, most: int = 65536) -> int:
    """How many salts deal `rows` rows of one key into groups of about
    per_group rows (more only beyond per_group * most rows of one key)."""
    return max(1, min(most, -(-rows // per_group)))


def drawn(rows: DataFrame, by: Column, n: int) -> DataFrame:
    """The rows with the n least different values of `by`, one for each, as
    column __h. Hashes alone are ordered; what else the rows hold is read in a
    second pass over those that are in, so no task and no driver gets more than
    n rows of it."""
    hashed = rows.withColumn("__h", by)
    last = hashed.select("__h").distinct().orderBy("__h").limit(n).agg(F.max("__h")).first()[0]
    return hashed.where(F.col("__h") <= F.lit(last)).dropDuplicates(["__h"])


def row_salt(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; an id of null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
