"""What the operators of this subpackage share: scratch tables, seeded samples, numbered tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch_roots: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of a batch that a Python worker gets, where the session sets no other bound: long texts cannot fill a worker.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors' Python workers, once a context, and bounds the batches that they get by bytes."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(bound, None) or 0) < 1 << 31:
        spark.conf.set(bound, str(BATCH_BYTES))
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    name = f"{package.name}-llm.zip"
    if not any(x.endswith(name) for x in context._python_includes):
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / name
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, f"{package.name}/{file.relative_to(package)}")
        context.addPyFile(str(target))


def _remove(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


@atexit.register
def _remove_all() -> None:
    for path, spark in _scratch_roots.items():
        _remove(path, spark)


#: Whether Spark removes a query's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Writes ``frame`` as Parquet to the shared folder and reads it back: lineage ends there, and any executor may be lost.

    What was shuffled for it is removed, so that the shuffles of several steps never lie on disk together.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _scratch_roots[path] = spark
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def drop_settled(*frames: DataFrame) -> None:
    """Removes tables of ``settle`` that no later plan reads."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            for path in list(_scratch_roots):
                if path.rpartition("/")[2] in file:
                    _remove(path, _scratch_roots.pop(path))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, seed: int, keep: Column, columns: list[str]) -> DataFrame:
    """At most ``bound`` labelled rows with their texts, the smallest by a seeded hash of the id.

    The bound holds whatever the size of the tables, so what is broadcast and trained on is bounded too.
    Rows whose id or label is null are never taken; of rows that repeat an id, one is.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .select("doc_id", F.col(label).cast("int").alias("__label"))
        .distinct()
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "__label")
        .limit(bound)
    )
    picked = documents.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id are one training row, so that they cannot exceed the bound.
    one = picked.groupBy("doc_id", "__label").agg(F.min(F.struct(*columns)).alias("row"))
    return settle(one.select("row.*", "__label"), "sample")
