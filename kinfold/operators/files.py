"""Duplicate files: by size, then by SHA-256 of the content.

Contents are read only for sizes that occur more than once: a first scan sees metadata alone, and the files that are left
are then hashed in tasks, block by block.
"""

from __future__ import annotations

import datetime
import os
import shutil
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.errors import ConfigurationError

#: Bytes of a file that are read at once.
BLOCK = 1 << 20


def scan(spark: SparkSession, folder: str, suffixes: Sequence[str] | None = None) -> DataFrame:
    """path, length, modified of all files below a folder; the contents are not read. Suffixes match in any case. As in
    every scan of Spark, names that begin with a dot or an underscore are hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))
    if suffixes:
        low = F.lower("path")
        match = F.lit(False)
        for s in suffixes:
            match = match | low.endswith(s.lower())
        files = files.where(match)
    return files


def same_size(files: DataFrame) -> DataFrame:
    """Files whose size occurs more than once."""
    sizes = files.groupBy("length").agg(F.count(F.lit(1)).alias("files_of_size")).where("files_of_size > 1")
    return files.join(sizes, "length")


def with_hash(files: DataFrame) -> DataFrame:
    """files(path, ...) with the SHA-256 of their contents. The paths are dealt to tasks, which read the files in blocks
    through Arrow's file systems: no path comes to the driver, and no content is held as a whole."""
    spread = files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.join(spread.mapInArrow(_hashes, "path string, hash string"), "path")


def _hashes(batches):
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            # Spark's paths are plain text, not escaped as URIs are.
            scheme, _, rest = path.partition(":")
            store, name = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
            digest = hashlib.sha256()
            with store.open_input_stream(name, compression=None) as data:
                while block := data.read(BLOCK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "hash"])


def duplicates(hashed: DataFrame) -> DataFrame:
    """A row per hash that occurs more than once among files(path, length, hash): files, total_size."""
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("total_size"), F.min("length").alias("size")).where("files > 1")


def preference(path: Column, preferred: Sequence[str]) -> Column:
    """Place of the first preferred folder that the path contains."""
    out = F.lit(len(preferred))
    for i, folder in reversed(list(enumerate(preferred))):
        out = F.when(path.contains(folder), i).otherwise(out)
    return out


def best_files(hashed: DataFrame, preferred: Sequence[str] = ()) -> DataFrame:
    """hashed with is_best: in each group of equal hashes the file in the first preferred folder, else the newest, else
    that with the shortest path in parts, else the first path. A minimum per group, no sort."""
    rank = F.struct(preference(F.col("path"), preferred).alias("a"), (-F.unix_micros(F.col("modified").cast("timestamp"))).alias("b"), F.size(F.split("path", "/")).alias("c"), F.col("path").alias("d"))
    best = hashed.groupBy("hash").agg(F.min(rank)["d"].alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(best, "hash").withColumn("is_best", F.col("path") == F.col("best")).drop("best")


def cleanup_plan(ranked: DataFrame, action: str = "recycle") -> DataFrame:
    """What cleanup would do: a row per file that is not the best of its group."""
    if action not in ("recycle", "delete", "archive"):
        raise ConfigurationError(f"unknown action: {action!r}")
    return ranked.where(~F.col("is_best")).select("path", "hash", F.col("length").alias("bytes_freed"), F.lit(action).alias("action"))


def statistics(hashed: DataFrame) -> DataFrame:
    """One row about duplicate groups."""
    d = duplicates(hashed)
    wasted = F.col("total_size") - F.col("size")
    return d.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_in_groups"),
        F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(wasted), F.lit(0)).alias("wasted_bytes"),
        (F.coalesce(F.sum(wasted), F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("wasted_mb"),
        F.coalesce(F.max("files"), F.lit(0)).alias("largest_group"),
        F.coalesce(F.avg("files"), F.lit(0.0)).alias("avg_group"),
    )


def find(spark: SparkSession, folder: str, suffixes: Sequence[str] | None = None, preferred: Sequence[str] = ()) -> DataFrame:
    """All files in groups of equal contents, with is_best."""
    return best_files(with_hash(same_size(scan(spark, folder, suffixes))), preferred)


def cleanup(plan: DataFrame, dry_run: bool = True, archive: str | None = None, root: str = "/") -> list[tuple[str, str]]:
    """Carries a plan out on the driver's file system, file by file: (path, what was done). Nothing changes in a dry run.
    Recycled files go to .recycle below root, archived ones to `archive`, both with their folders; a name that is taken
    gets a time stamp."""
    done = []
    for row in plan.toLocalIterator():
        path = row["path"].removeprefix("file:")
        if dry_run:
            done.append((path, f"would {row['action']}"))
        elif row["action"] == "delete":
            os.remove(path)
            done.append((path, "deleted"))
        else:
            base = archive if row["action"] == "archive" else os.path.join(root, ".recycle")
            if base is None:
                raise ConfigurationError("an archive folder is needed")
            target = os.path.join(base, os.path.relpath(path, root))
            if os.path.exists(target):
                stem, suffix = os.path.splitext(target)
                target = f"{stem}_{datetime.datetime.now():%Y%m%d%H%M%S%f}{suffix}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.move(path, target)
            done.append((path, target))
    return done
