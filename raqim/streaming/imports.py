"""Continuous import of files into the store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raqim.operators.store import upsert


class Versions:
    """A table kept in buckets by the hash of ``key``, each a folder of its last version.

    A batch rewrites only the buckets it touches, then writes a pointer that names the folder
    of every bucket, so readers never see half a version and a batch that is run again writes
    the same rows. Pointers are numbered, the greatest holds; all files go through Hadoop's
    file system, so the folder may be on any store that Spark can write. Folders that no
    pointer but those before the last named are removed. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "file_name", buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _pointers(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("pointer-"))

    def _named(self, pointer: str) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.folder}/{pointer}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        names = self._pointers()
        return self._named(names[-1]) if names else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = self.current()
        paths = [f"{self.folder}/{name}/bucket={b}" for b, name in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, order: tuple[str, ...]) -> None:
        """``rows`` laid over the table; of equal keys the last by ``order`` wins, then the one there."""
        rows = rows.persist()
        touched = [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        if touched:
            merged = upsert(self.read(touched), rows, (self.key,), order)
            name = f"v-{uuid.uuid4().hex}"
            merged.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
            self._point(self.current() | {str(b): name for b in touched})
        rows.unpersist()

    def _point(self, held: dict[str, str]) -> None:
        names = self._pointers()
        at = int(names[-1].rpartition("-")[2]) + 1 if names else 0
        temporary, final = (self._path(f"{self.folder}/{n}") for n in (f".pointer-{uuid.uuid4().hex}", f"pointer-{at:012d}"))
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise OSError(f"{final.toString()} could not be written")
        # the last pointer and the one before stay for readers that have begun
        for old in names[:-1]:
            self._fs.delete(self._path(f"{self.folder}/{old}"), False)
        kept = {v for n in [*names[-1:], final.getName()] for v in self._named(n).values()}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in kept:
                self._fs.delete(s.getPath(), True)


FILES = "file_name STRING, modified TIMESTAMP, text STRING"
ORDER = ("modified", "text")


def import_rows(stream: DataFrame, store: Versions, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Import a stream of (file_name, modified, text); the last version of a file name wins. ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(lambda df, _: store.merge(df, ORDER)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def import_stream(spark: SparkSession, source: str, store: Versions, checkpoint: str, pattern: str = "*.json", once: bool = True) -> StreamingQuery:
    """Import new files of a folder.

    The file source knows files by path: one that was changed in place is taken up by ``sync``.
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).schema("value STRING").load(source)
    return import_rows(_files(stream), store, checkpoint, once)


def _files(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def sync(spark: SparkSession, source: str, store: Versions, pattern: str = "*.json") -> int:
    """Import files that are new or newer than the stored version; how many there were."""
    rows = _files(spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(source))
    known = store.read().select("file_name", F.col("modified").alias("seen"))
    fresh = rows.join(known, "file_name", "left").where("seen IS NULL OR modified > seen").drop("seen")
    n = fresh.count()
    if n:
        store.merge(fresh, ORDER)
    return n
