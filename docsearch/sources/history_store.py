"""The search history as a table of snapshots: loads are merged in by key, patches by id, and only the parts they touch are rewritten.

Entries lie in BUCKETS parts by a hash of their parameters' key; a part is a folder of Parquet for each version. The catalogue, one small
file, says which version of each part counts; it is moved into its place when all parts of a load are written, so readers see a load
as a whole or not at all, and a load that fails leaves the old snapshot (and parts that nothing names, for ``vacuum``). One writer at
a time: a writer that finds another catalogue than it began with stops.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.operators import history
from docsearch.sources.files import exists, place, write_whole

BUCKETS = 64
CATALOGUE = "_catalogue.json"
SCHEMA = f"id long, ts timestamp, name string, is_favorite boolean, params {history.PARAMS}"


class Conflict(RuntimeError):
    """Another load was committed meanwhile."""


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def catalogue(self) -> dict:
        """version, and the folder of each part that has entries."""
        if not exists(f"{self.path}/{CATALOGUE}"):
            return {"version": 0, "buckets": self.buckets, "parts": {}}
        at, name = place(f"{self.path}/{CATALOGUE}")
        with at.open_input_stream(name) as f:
            return json.loads(f.read())

    def _of(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{p}" for p in parts.values()))

    def read(self) -> DataFrame:
        """The entries of the newest snapshot."""
        return self._of(self.catalogue()["parts"])

    def _bucket(self, entries: DataFrame, buckets: int) -> DataFrame:
        return entries.withColumn("_bucket", F.pmod(F.xxhash64(history.params_key(F.col("params"))), F.lit(buckets)).cast("int"))

    def _commit(self, before: dict, entries: DataFrame, touched: list[int]) -> int:
        """Writes the parts ``touched`` anew from ``entries`` (with _bucket) and names them in the catalogue."""
        folder = f"v{before['version'] + 1:08d}-{uuid.uuid4().hex}"
        entries.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at, name = place(f"{self.path}/{folder}")
        there = {str(k) for k in touched if exists(f"{self.path}/{folder}/_bucket={k}")}
        parts = {k: p for k, p in before["parts"].items() if int(k) not in touched} | {k: f"{folder}/_bucket={k}" for k in there}
        if self.catalogue()["version"] != before["version"]:
            at.delete_dir(name)
            raise Conflict("another load was committed meanwhile; load again")
        write_whole(f"{self.path}/{CATALOGUE}", json.dumps({"version": before["version"] + 1, "buckets": before["buckets"], "parts": parts}).encode())
        return before["version"] + 1

    def load(self, entries: DataFrame) -> int:
        """Merges new entries in, as ``history.dedupe`` of all loads together where they come in the order of time: of equal parameters the first
        id, name and favourite and the newest time. A load that comes twice changes nothing. Returns the new version."""
        before = self.catalogue()
        new = self._bucket(history.dedupe(entries.select("id", "ts", "name", "is_favorite", "params")), before["buckets"])
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` rows
        old = self._bucket(self._of({k: p for k, p in before["parts"].items() if int(k) in touched}), before["buckets"])
        return self._commit(before, self._bucket(history.merge(old.drop("_bucket"), new.drop("_bucket")), before["buckets"]), touched)

    def patch(self, patches: DataFrame) -> int:
        """Sets name and is_favorite by id (``history.update``), rewriting the parts that hold such an id."""
        before = self.catalogue()
        all_ = self._bucket(self._of(before["parts"]), before["buckets"])
        touched = sorted(r[0] for r in all_.join(patches.select("id").distinct(), "id", "left_semi").select("_bucket").distinct().collect())
        if not touched:
            return before["version"]
        some = self._of({k: p for k, p in before["parts"].items() if int(k) in touched})
        return self._commit(before, self._bucket(history.update(some, patches), before["buckets"]), touched)

    def vacuum(self) -> int:
        """Deletes the folders that no part of the snapshot lies in; returns their number."""
        at, top = place(self.path)
        from pyarrow.fs import FileSelector

        named = {p.split("/")[0] for p in self.catalogue()["parts"].values()}
        gone = [i for i in at.get_file_info(FileSelector(top, allow_not_found=True)) if i.base_name.startswith("v") and i.base_name not in named]
        for i in gone:
            at.delete_dir(i.path)
        return len(gone)
