"""What the operators need of the session: a shared folder for checkpoints and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or set on the context; a temporary one only for a local master that names none (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievelake-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def scratch_table(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, for as long as the block runs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelake-{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path)
    del df  # what it was made from may go
    release(spark)
    try:
        yield spark.read.parquet(path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of frames that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the folder in ``spark.checkpoint.dir``.

    All executors share that folder, so a lost executor costs no recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (Spark compares names without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session: they need not have it installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_sievelake_shipped", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="sievelake-")) / "sievelake.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._sievelake_shipped = True


def python_stage(spark: SparkSession) -> None:
    """Call before a step that runs Python on the executors: ships the package, and lets Spark cut Arrow
    batches by bytes, so that very long texts don't pile up in one worker. The setting stays for the session: the step is only
    planned here and may run at any later time."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def is_held_out() -> F.Column:
    """The fold of the contracts: crc32 of the doc_id as text, modulo 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
