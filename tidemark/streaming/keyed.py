"""A table of changing rows on a store of files, for streams in update mode.

Each batch writes the rows that it changed as a part of level 0. As soon as FAN parts of a level are there, they are merged
into one of the next level that holds the newest row of each key. A pointer file names the parts that make up the table and
the last batch; it is written beside and renamed, so readers see the table before a batch or after it. A table has fewer
than FAN parts a level, and a row is rewritten once a level: both grow with the logarithm of the batches. A batch that comes
again after a failure finds its number in the pointer and changes nothing; one whose pointer was not written is done anew
over the same names. Files that neither of the last two pointers names are deleted, so readers have a batch's time to end.

All files are reached by Spark and Hadoop's file systems, not by local paths.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

FAN, BATCH = 8, "_batch"


class Files:
    """The few file operations that are needed, on whatever store a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written under another name and renamed."""
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.at(draft), self.at(name)):
            raise OSError(f"{name} is there already")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _pointers(files: Files) -> list[int]:
    return sorted(int(n) for n in files.names("_pointers") if n.isdigit())


def _pointer(files: Files, number: int | None = None) -> dict:
    """What the newest pointer says: its number, the parts as [level, name] and the last batch."""
    found = _pointers(files) if number is None else [number]
    return json.loads(files.read(f"_pointers/{found[-1]:012d}")) | {"number": found[-1]} if found else {"number": 0, "parts": [], "batch": -1}


def newest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch of each key."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("row")).select(*keys, "row.*")


def add(batch: DataFrame, number: int, path: str, keys: list[str], fan: int = FAN) -> None:
    """Adds the changed rows of a batch."""
    spark = batch.sparkSession
    files = Files(spark, path)
    now = _pointer(files)
    if number <= now["batch"]:
        return
    files.fs.mkdirs(files.at("_pointers"))
    name = f"part-{number}-0"
    batch.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{name}")
    parts, level = [*now["parts"], [0, name]], 0
    while len(full := [p for p in parts if p[0] == level]) >= fan:
        level += 1
        name = f"part-{number}-{level}"
        newest(spark.read.parquet(*(f"{path}/{p[1]}" for p in full)), keys).write.mode("overwrite").parquet(f"{path}/{name}")
        parts = [p for p in parts if p not in full] + [[level, name]]
    files.write(f"_pointers/{now['number'] + 1:012d}", json.dumps({"parts": parts, "batch": number}))
    kept = {p[1] for p in parts} | {p[1] for p in now["parts"]}
    for n in _pointers(files)[:-2]:
        files.delete(f"_pointers/{n:012d}")
    for n in files.names(""):
        if n.startswith("part-") and n not in kept:
            files.delete(n)


def current(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """The table's rows now. schema: that of the stream, for a table without a batch."""
    parts = _pointer(Files(spark, path))["parts"]
    if not parts:
        return spark.createDataFrame([], schema)
    return newest(spark.read.parquet(*(f"{path.rstrip('/')}/{p[1]}" for p in parts)), keys).drop(BATCH)


def parts(spark: SparkSession, path: str) -> list[str]:
    """The names of the parts that make up the table."""
    return [p[1] for p in _pointer(Files(spark, path))["parts"]]
