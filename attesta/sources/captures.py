"""A content-addressed store of captures: bodies and what was retrieved, both in buckets of the content's hash.

A capture meets its body bucket by bucket, without a shuffle of bytes, and bodies
that are there already aren't written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


class CaptureStore:
    """Two tables in the session's catalog, ``name``_bodies (content_hash, content) and ``name``_captures, with their files under ``folder``."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder, buckets

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _add(self, rows: DataFrame, part: str) -> None:
        writer = rows.repartition(self.buckets, "content_hash").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "content_hash").sortBy("content_hash").option("path", f"{self.folder}/{part}").saveAsTable(self._table(part))

    def _has(self, part: str) -> bool:
        return self.spark.catalog.tableExists(self._table(part))

    def add(self, captures: DataFrame, blobs: DataFrame) -> None:
        """Add captures whose source_id isn't there yet, and bodies whose hash isn't.

        Bodies first: a capture that readers see has its body.  Rows: of repeated
        hashes and ids one stays; a null hash is no address, so such a body is left
        out and its capture's body counts as missing.
        """
        bodies = blobs.filter("content_hash IS NOT NULL").dropDuplicates(["content_hash"])
        own = captures.dropDuplicates(["source_id"])
        if self._has("bodies"):
            bodies = bodies.join(self.bodies().select("content_hash"), "content_hash", "left_anti")
        if self._has("captures"):
            own = own.join(self.captures().select("source_id"), "source_id", "left_anti")
        self._add(bodies.select("content_hash", "content"), "bodies")
        self._add(own, "captures")

    def bodies(self) -> DataFrame:
        return self.spark.table(self._table("bodies"))

    def captures(self) -> DataFrame:
        return self.spark.table(self._table("captures"))
