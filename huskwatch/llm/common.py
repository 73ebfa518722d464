"""Small helpers shared by the operators: words, row keys, shared folders, ranges."""
from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words of the plain word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same six.
SPACES = b" \t\n\x0b\x0c\r"


#: Rows that go to a Python worker at once; texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker of this session holds at once; called by the queries and the pipeline."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir; a local one only under a local master (tests)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept, master = spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
        if not kept and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = kept or "file://" + tempfile.mkdtemp(prefix="llm-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory of a Python worker to the system at a task's end: workers live on, and the next stages' tasks share
    their executor's limit with what they would keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(text: Column) -> Column:
    """With doc_id it names a row's text; rows with equal doc_id and text share every result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Shuffle by the columns into at least as many partitions as the session has for shuffles."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def nested(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct ``row_``, so that a column an operator adds clashes with none of the row's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the rows that nested() put away, but for those given anew."""
    return df.select(*[changed.get(c, F.col("row_")[c]).alias(c) for c in columns])


def merged(ranges) -> list[tuple[int, int]]:
    """Sorted disjoint half-open ranges that cover the given ones."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path, None for other stores."""
    if m := re.match(r"file:(?://)?(/.*)", uri):
        return m[1]
    return uri if uri.startswith("/") else None
