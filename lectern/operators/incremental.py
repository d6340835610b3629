"""Inventories by time: what changed between two snapshots of a collection, and scans of that alone.

A manifest has a row per file: path, type, size, time and digest. Two manifests give each file's
status; only new and changed files are scanned, and the findings stored for the others stay. All steps
are joins on the path, so cost follows the files listed and the texts that changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lectern.storage import stored

#: What can have become of a file.
STATUS = ("new", "changed", "unchanged", "deleted")


def manifest(files: DataFrame, content_col: str = "content") -> DataFrame:
    """path, type, size_bytes, modified and the SHA-256 of the content (of an empty one for null) of each file."""
    digest = F.sha2(F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary")), 256)
    return files.select("path", "type", "size_bytes", "modified", digest.alias("digest"))


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, type, status, touched of every file of two manifests.

    Changed means another digest; ``touched`` tells that the time moved though the content did not. Of
    several rows of one path in a manifest the latest counts (ties: the largest digest); a null path is left out.
    """

    def latest(rows: DataFrame, name: str) -> DataFrame:
        one = rows.filter("path is not null").groupBy("path").agg(F.max(F.struct("modified", "digest", "type")).alias(name))
        return one.select(F.col("path"), F.col(name))

    both = latest(before, "old").join(latest(now, "new"), "path", "full")
    same = F.col("old.digest").eqNullSafe(F.col("new.digest"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    touched = (status == "unchanged") & ~F.col("old.modified").eqNullSafe(F.col("new.modified"))
    return both.select("path", F.coalesce("new.type", "old.type").alias("type"), status.alias("status"), touched.alias("touched"))


def delta_inventory(changes: DataFrame, *keys: str) -> DataFrame:
    """Per type, folder or whatever ``keys`` say: how many files are new, changed, unchanged, touched only, and deleted."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUS]
    return changes.groupBy(*keys).agg(*counts, F.count_if("touched").alias("touched"))


def modified_since(files: DataFrame, time) -> DataFrame:
    """Files whose time is later than ``time``, for collections without an earlier manifest."""
    return files.filter(F.col("modified") > F.lit(time))


def to_scan(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files that are new or changed."""
    return files.join(changes.filter(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi")


def refreshed(kept: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings (path, ...) of the collection as it is now: stored ones of unchanged files and fresh ones of the others."""
    still = kept.join(changes.filter("status = 'unchanged'").select("path"), "path", "left_semi")
    return still.select(kept.columns).unionByName(fresh.select(kept.columns))


def scan_changes(files: DataFrame, before: DataFrame, kept: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The manifest and the findings of ``files`` now, given the manifest and findings of an earlier time.

    ``scan`` turns files into findings with a path and is given the new and changed ones only. The
    manifest and the result are stored, so that they can be the next time's.
    """
    now = stored(manifest(files), "manifest")
    changes = stored(delta(before, now), "delta")
    return now, stored(refreshed(kept, scan(to_scan(files, changes)), changes), "refreshed")
