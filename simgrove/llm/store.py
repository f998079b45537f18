"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: every executor sees that folder,
so the loss of an executor costs a recomputation of its running tasks and nothing else.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose derived small tables fill one file.
ROWS_PER_FILE = 100_000
#: Rows of a side that may be broadcast; a row of keys takes some 50 bytes.
BROADCAST_ROWS = 100_000
#: Shuffle files go when the write that needed them is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where the session names none: a temporary one on a local master,
    an error on a cluster, whose executors wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="simgrove-"))


class Workspace:
    """Tables of one operator run. ``keep`` writes and rereads one, ``drop`` deletes one early, ``only`` all others."""

    def __init__(self, spark: SparkSession, name: str, docs: DataFrame | None = None):
        self.spark, self.docs, self.kept, self._files = spark, docs, [], None
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    @property
    def files(self) -> int:
        """Files of a table that is small beside the documents: one for each ROWS_PER_FILE documents."""
        if self._files is None:
            rows = self.docs.count() if self.docs is not None else 0
            self._files = max(2, min(shuffle_width(self.spark), math.ceil(rows / ROWS_PER_FILE)))
        return self._files

    def keep(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Write df once and return it as read back; the shuffle files that fed it are released. Most columns are
        hashes, so no codec: its buffers lie outside the heap. small: few bytes for each document, so fewer files."""
        if small:
            df = df.repartition(self.files)
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "none").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        self.kept.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.kept.remove(name)

    def only(self, *names: str) -> None:
        """Delete all tables but those, which the result still reads."""
        for name in [n for n in dict.fromkeys(self.kept) if n not in names]:
            self.drop(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df bears it (case doesn't count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most that many rows, else to be sorted and merged. df: a kept table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_document_order(docs: DataFrame, space: Workspace) -> tuple[DataFrame, bool]:
    """doc_id, text, content (a hash of the text) and ord of each row: a bigint that orders documents by doc_id;
    and whether no two rows share an ord.

    Where doc_id is unique and never null, ord is doc_id itself. Otherwise documents are the distinct pairs
    of doc_id (null first) and text, ordered by doc_id and then by a hash of the text; equal rows share an ord.
    """
    from pyspark import TaskContext
    from pyspark.sql import Window

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    given = given.withColumn("content", F.xxhash64("text"))
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    repeated = given.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if whole and not repeated.limit(1).count():
        return given.select("doc_id", "text", "content", F.col("doc_id").cast("bigint").alias("ord")), True

    def number(batches):
        import numpy as np
        import pyarrow as pa

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*b.schema.names, "part", "at"])
            at += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = given.select("doc_id", "content").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "content")
    places = space.keep(ordered.mapInArrow(number, f"doc_id {kind}, content bigint, part int, at bigint"), "places")
    totals = space.keep(places.groupBy("part").count(), "place-totals")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    places = places.join(bases, "part").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), (F.col("base") + F.col("at")).alias("ord"))
    return given.join(places, given["doc_id"].eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))).select("doc_id", "text", "content", "ord"), False
