"""What the training-data operators share: the shared folder, table access and chunked text."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that a Python worker unpacks at once, so that its memory does not follow the batch size.
CHUNK_CHARS = 1 << 21


#: Rows of text in an Arrow batch between Spark and its Python workers, so that a worker's memory stays small, and rows
#: that a worker takes at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 4000
SMALL_BATCHES = {ARROW_ROWS: str(BATCH)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset (tests, a laptop) the driver's
    temporary folder serves, which is only right in local mode.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/linkloom-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH rows from here on, for plans that Python workers read texts in and that
    run after the operator has returned."""
    if int(spark.conf.get(ARROW_ROWS)) > BATCH:
        spark.conf.set(ARROW_ROWS, str(BATCH))


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the jobs that are run inside; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    The job's shuffle files go when it has ended; ``discard`` deletes the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with settings(spark, **SMALL_BATCHES, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t._stored_at)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters together, with the place of the first; a text is never cut."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def batches_of(it: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, each with underscores put after it until no column of ``taken`` has it in any case."""
    out, held = [], {c.lower() for c in taken}
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def fraction_of(key, share: float):
    """A condition that keeps about ``share`` of the rows, by a hash of key; the same rows each time."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
