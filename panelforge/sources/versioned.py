"""Tables in versions: files never change, a version is a small manifest of folders, and the next one is claimed by one writer alone.

A table's folder holds ``data/<commit>/...`` (Parquet) and ``log/<version>.json``. A reader pins a version and sees it to the end, whatever is
written meanwhile; a writer states the version that it has read, and loses (:class:`Conflict`) if another was quicker. Streams keep their
progress in the same manifests, so that rows and progress become visible together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.sources import shared

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one has read."""


class Table:
    """A table at ``path``; with ``by``, a column whose values are replaced as wholes and alone."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None):
        self.spark, self.path, self.by = spark, path, by

    def latest(self) -> int:
        """The last version's number; 0 before the first."""
        return max((int(n[:-5]) for n in shared.names(self.spark, f"{self.path}/log") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``version, schema, parts`` (each with ``key`` and ``folder``), ``streams``, ``note``."""
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "parts": [], "streams": {}, "note": None}
        return json.loads(shared.text_of(self.spark, f"{self.path}/log/{version:012d}.json"))

    def read(self, version: int | None = None, schema: StructType | None = None, keys: set[str] | None = None) -> DataFrame:
        """A version's rows (the last one's, as of now), or those of some values of ``by``; ``schema`` is for a table without versions."""
        m = self.manifest(version)
        kind = StructType.fromJson(m["schema"]) if m["schema"] else schema
        if kind is None:
            raise FileNotFoundError(f"{self.path} has no version")
        folders = [f"{self.path}/{p['folder']}" for p in m["parts"] if keys is None or p["key"] in keys]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def written(self, df: DataFrame) -> list[dict]:
        """Write rows that no version has yet; returns their parts."""
        folder = f"data/{uuid.uuid4().hex}"
        if not self.by:
            df.write.parquet(f"{self.path}/{folder}")
            return [{"key": "", "folder": folder}]
        df.withColumn("_part", F.col(self.by).cast("string")).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        found = [n for n in shared.names(self.spark, f"{self.path}/{folder}") if n.startswith("_part=")]
        return [{"key": unquote(n.removeprefix("_part=")), "folder": f"{folder}/{n}"} for n in found]

    def commit(self, read: int, parts: list[dict], schema: StructType | dict, note: str = "", streams: dict | None = None) -> int:
        """Make ``parts`` the version after ``read``; raises :class:`Conflict` if there is one."""
        before = self.manifest(read)["streams"] if streams is None else streams
        text = json.dumps({"version": read + 1, "schema": schema if isinstance(schema, dict) else json.loads(schema.json()), "parts": parts, "streams": before, "note": note})
        shared.located(self.spark, f"{self.path}/log")[0].mkdirs(shared.located(self.spark, f"{self.path}/log")[1])
        if not shared.put_if_absent(self.spark, f"{self.path}/log/{read + 1:012d}.json", text):
            raise Conflict(f"version {read + 1} of {self.path} is another writer's")
        return read + 1

    def replace(self, df: DataFrame, read: int | None = None) -> int:
        """``df`` as the whole table."""
        read = self.latest() if read is None else read
        return self.commit(read, self.written(df), df.schema, "replace")

    def replace_parts(self, df: DataFrame, read: int | None = None) -> int:
        """The values of ``by`` that ``df`` has are replaced, all in one version; others stay as they are."""
        read = self.latest() if read is None else read
        new = self.written(df)
        names = {p["key"] for p in new}
        return self.commit(read, [p for p in self.manifest(read)["parts"] if p["key"] not in names] + new, df.schema, "replace_parts")

    def update(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], read: int | None = None, attempts: int = 1) -> int:
        """``merge`` of the table (of the values of ``by`` that ``new`` has) and ``new``; after a conflict it is made again from the newer version."""
        touched = {r[0] if r[0] is not None else NO_VALUE for r in new.select(F.col(self.by).cast("string")).distinct().collect()} if self.by else None  # as many as there are folders
        for left in range(attempts, 0, -1):
            at = self.latest() if read is None else read
            merged = merge(self.read(at, new.schema, touched), new)
            try:
                parts = self.written(merged)
                rest = [] if touched is None else [p for p in self.manifest(at)["parts"] if p["key"] not in touched]
                return self.commit(at, rest + parts, merged.schema, "update")
            except Conflict:
                if left == 1 or read is not None:
                    raise
        raise ValueError("attempts has to be 1 or more")

    def append(self, df: DataFrame, streams: dict | None = None, read: int | None = None, note: str = "append") -> int:
        read = self.latest() if read is None else read
        return self.commit(read, self.manifest(read)["parts"] + self.written(df), df.schema, note, streams)

    def compact(self, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """The folders of the present version as one, ``fold`` applied; what is appended meanwhile stays beside it, so streams may go on."""
        m = self.manifest()
        old = {p["folder"] for p in m["parts"]}
        parts = self.written(fold(self.read(m["version"])))
        while True:
            now = self.manifest()
            if not old <= {p["folder"] for p in now["parts"]}:
                raise Conflict(f"folders of {self.path} were replaced during compaction")
            try:
                return self.commit(now["version"], parts + [p for p in now["parts"] if p["folder"] not in old], now["schema"], "compact")
            except Conflict:
                continue  # another batch was appended: the folded folders are still right

    def vacuum(self, keep: int = 10) -> int:
        """Delete folders that none of the last ``keep`` versions has, and older manifests; returns how many folders went.

        Only for times without writers: what a writer has not committed yet is deleted as well.
        """
        versions = sorted(int(n[:-5]) for n in shared.names(self.spark, f"{self.path}/log") if n.endswith(".json"))
        held = {p["folder"].split("/")[1] for v in versions[-keep:] for p in self.manifest(v)["parts"]}
        gone = [n for n in shared.names(self.spark, f"{self.path}/data") if n not in held]
        for v in versions[:-keep]:
            shared.remove(self.spark, f"{self.path}/log/{v:012d}.json")
        for n in gone:
            shared.remove(self.spark, f"{self.path}/data/{n}")
        return len(gone)
