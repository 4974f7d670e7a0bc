"""Stored tables: hash-bucketed, copied on write, published by one manifest.

A store is a folder with one numbered manifest per commit. A manifest names, for a whole set
of tables, the folders that hold each bucket's rows and how many rows they have, so readers
see all tables of one load or none of it. Rows of a table lie in ``buckets`` parts by a hash
of their key; an upsert reads and rewrites the buckets that its keys fall into and leaves the
others where they are. A commit is published under the next number only if nobody else has
taken it; a writer that loses the race applies its buckets to the newer manifest, or, where
the other one changed what it had read, works its rows out again. Data folders have names of
their own and are never overwritten, so a lost attempt leaves readers untouched.

Deletes are batches of keys (tombstones) that take effect on read for rows written before
them; ``compact`` writes the remaining rows and forgets the batches.

A manifest's size is tables times buckets, not rows; rows never pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import align_to, numbered_folders

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Update:
    """New rows of a table. ``merge(current, fresh)`` gets the touched buckets' rows and returns what they hold then;
    without it the rows of ``fresh`` replace all rows of their keys (and of ``keys``, if given).

    ``fresh`` is read several times, so it is staged first, unless it already ``is_staged``."""
    fresh: DataFrame
    merge: Merge | None = None
    keys: DataFrame | None = None
    is_staged: bool = False


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    # ------------------------------------------------------------ manifests
    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the latest commit; -1 for an empty store."""
        found = numbered_folders(self.spark, f"{self.root}/commits", "n=", completed=False)
        return found[-1] if found else -1

    def manifest(self, version: int | None = None) -> dict:
        """``{table: entry}`` of a commit (the latest by default)."""
        n = self.version() if version is None else version
        if n < 0:
            return {}
        path, fs = self._fs(f"{self.root}/commits/n={n}")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, n: int, tables: dict) -> bool:
        """Make commit ``n`` visible, whole, unless someone else has: then False."""
        scratch, fs = self._fs(f"{self.root}/commits/tried-{uuid.uuid4().hex}")
        target, _ = self._fs(f"{self.root}/commits/n={n}")
        out = fs.create(scratch, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if fs.getUri().getScheme() != "file":
            return not fs.exists(target) and bool(fs.rename(scratch, target))   # a rename onto a name that exists fails
        local = self._jvm.java.nio.file.Paths
        names = [local.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                 for p in (target, scratch)]
        try:                                        # a local rename would overwrite; a link does not
            self._jvm.java.nio.file.Files.createLink(*names)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            fs.delete(scratch, False)

    # ------------------------------------------------------------- reading
    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def count(self, name: str, default: int = 0) -> int:
        """Rows of a table, read off the manifest (A18); ``default`` where there is none.

        With tombstones the rows are counted, since a tombstone may name rows that are not there.
        """
        entry = self.manifest().get(name)
        if entry is None:
            return default
        if entry["tombstones"]:
            return self._rows(name, entry).count()
        return sum(f["rows"] for found in entry["parts"].values() for f in found)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table in one commit; None where it has no such table."""
        entry = self.manifest(version).get(name)
        return None if entry is None else self._rows(name, entry)

    def _rows(self, name: str, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        base = f"{self.root}/data/{name}"
        parts = [(f, b) for b, found in entry["parts"].items() for f in found if buckets is None or int(b) in buckets]
        if not parts:
            return self.spark.createDataFrame([], schema).filter(F.lit(False))     # the planner sees that it is empty
        # folder and bucket are read off the path; both are part of the files' schema, so none is inferred
        whole = T.StructType([*schema.fields, T.StructField("_folder", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        df = (self.spark.read.schema(whole).option("basePath", base)
              .parquet(*[f"{base}/_folder={f['folder']}/_bucket={b}" for f, b in parts]))
        names = [f.name for f in schema.fields]
        if entry["tombstones"]:
            at = F.create_map(*[F.lit(x) for f in {f["folder"]: f["commit"] for f, _ in parts}.items() for x in f])
            df = df.select(*names, at[F.col("_folder")].alias("_commit"))
            gone = self.spark.read.option("basePath", f"{base}/_gone").parquet(
                *[f"{base}/_gone/_folder={t['folder']}" for t in entry["tombstones"]])
            when = F.create_map(*[F.lit(x) for t in entry["tombstones"] for x in (t["folder"], t["commit"])])
            gone = gone.groupBy(*entry["key"]).agg(F.max(when[F.col("_folder")]).alias("_gone"))
            same = [df[k].eqNullSafe(gone[k]) for k in entry["key"]]
            df = df.join(gone, [*same, df["_commit"] < gone["_gone"]], "left_anti")
        return df.select(*names)

    # ------------------------------------------------------------- writing
    def _bucket(self, entry: dict):
        return F.pmod(F.xxhash64(*entry["key"]), F.lit(entry["buckets"])).cast("int")

    def _write(self, name: str, entry: dict, df: DataFrame) -> dict[str, list[dict]]:
        """Write rows by bucket into a new folder: ``{bucket: [part]}``."""
        folder = f"x{uuid.uuid4().hex}"           # never read as a number
        base = f"{self.root}/data/{name}"
        rows = align_to(df, T.StructType.fromJson(entry["schema"])).withColumn("_bucket", self._bucket(entry))
        # a bucket grows with its table: rebalancing splits it into several files, so that no task gets all of it
        (rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{base}/_folder={folder}"))
        path, fs = self._fs(f"{base}/_folder={folder}")
        if not any(s.getPath().getName().startswith("_bucket=") for s in fs.listStatus(path)):
            return {}
        # row counts come from the files' footers, one group a bucket
        counts = self.spark.read.parquet(f"{base}/_folder={folder}").groupBy("_bucket").count().collect()
        return {str(r["_bucket"]): [{"folder": folder, "rows": r["count"]}] for r in counts}

    def staged(self, df: DataFrame) -> DataFrame:
        """The same rows, worked out once and written as Parquet beside the tables."""
        path = f"{self.root}/staged/x{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, build: Callable[[dict], dict[str, dict]], tries: int = 20) -> int:
        """Publish what ``build(manifest)`` returns: ``{table: {"entry", "parts", "append", "tombstones", "whole"}}``."""
        version = self.version()
        base = self.manifest(version)
        made = build(base)
        for _ in range(tries):
            n = version + 1
            tables = dict(base)
            for name, change in made.items():
                entry = json.loads(json.dumps(tables.get(name) or change["entry"]))
                parts = {b: [f | {"commit": n} for f in found] for b, found in change.get("parts", {}).items()}
                if change.get("whole"):
                    entry = json.loads(json.dumps(change["entry"])) | {"parts": parts, "tombstones": []}
                elif change.get("append"):
                    for b, found in parts.items():
                        entry["parts"].setdefault(b, []).extend(found)
                else:
                    entry["parts"] = {b: f for b, f in (entry["parts"] | {b: parts.get(b, []) for b in change.get("touched", [])}).items() if f}
                entry["tombstones"] = entry["tombstones"] + [{"folder": f, "commit": n} for f in change.get("tombstones", [])]
                tables[name] = entry
            if self._publish(n, tables):
                return n
            version, old = self.version(), base
            base = self.manifest(version)
            if any(self._read_differs(old.get(name), base.get(name), change) for name, change in made.items()):
                made = build(base)                   # what was read has changed meanwhile
        raise RuntimeError(f"{self.root}: {tries} commits by others came first")

    @staticmethod
    def _read_differs(old: dict | None, new: dict | None, change: dict) -> bool:
        if change.get("append") or change.get("whole"):
            return False
        if old is None or new is None:
            return old is not new
        return old["tombstones"] != new["tombstones"] or any(old["parts"].get(b) != new["parts"].get(b) for b in change.get("touched", []))

    def create(self, name: str, schema: T.StructType, key: list[str], buckets: int = 32) -> None:
        """An empty table, unless there is one of this name."""
        entry = {"schema": schema.jsonValue(), "key": key, "buckets": buckets, "parts": {}, "tombstones": []}
        self._commit(lambda base: {} if name in base else {name: {"entry": entry, "touched": []}})

    def replace_all(self, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = 32) -> int:
        """K1: the rows of several tables, each with its key, become their whole content in one commit."""
        made = {}
        for name, (df, key) in tables.items():
            entry = {"schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "parts": {}, "tombstones": []}
            made[name] = {"entry": entry, "whole": True, "parts": self._write(name, entry, df)}
        return self._commit(lambda base: made)

    def append(self, name: str, df: DataFrame) -> int:
        """K2: add rows, aligned to the table's columns; no bucket is rewritten."""
        entry = self.manifest()[name]
        made = {name: {"append": True, "parts": self._write(name, entry, df)}}
        return self._commit(lambda base: made)

    def update(self, updates: dict[str, Update]) -> int:
        """Upsert into several tables in one commit, rewriting only the buckets of the keys given."""
        updates = {name: u if u.is_staged else replace(u, fresh=self.staged(u.fresh), is_staged=True) for name, u in updates.items()}

        def build(base: dict) -> dict[str, dict]:
            return {name: self._merged(name, base[name], u) for name, u in updates.items()}
        return self._commit(build)

    def _merged(self, name: str, entry: dict, u: Update) -> dict:
        key = entry["key"]
        keys = u.fresh.select(*key) if u.keys is None else u.fresh.select(*key).unionByName(u.keys.select(*key))
        touched = {r[0] for r in keys.select(self._bucket(entry)).distinct().collect()}     # at most ``buckets`` numbers
        current = self._rows(name, entry, touched)
        if u.merge is not None:
            rows = u.merge(current, u.fresh)
        else:
            gone = keys.distinct().select(*[F.col(k).alias(f"_{k}") for k in key])
            same = [current[k].eqNullSafe(gone[f"_{k}"]) for k in key]
            rows = current.join(gone, same, "left_anti").unionByName(align_to(u.fresh, current.schema))
        return {"touched": sorted(map(str, touched)), "parts": self._write(name, entry, rows)}

    def delete(self, names: list[str], keys: DataFrame) -> int:
        """The rows of these keys go from all the tables, in one commit that rewrites no row."""
        made = {}
        for name in names:
            folder = f"x{uuid.uuid4().hex}"
            (keys.select(*self.manifest()[name]["key"]).distinct().write
             .parquet(f"{self.root}/data/{name}/_gone/_folder={folder}"))
            made[name] = {"append": True, "tombstones": [folder]}
        return self._commit(lambda base: made)

    def compact(self, name: str) -> int:
        """Write the rows that are left, one part a bucket, and drop the tombstones."""
        for _ in range(20):
            version = self.version()
            base = self.manifest(version)
            entry = base[name]
            parts = {b: [f | {"commit": version + 1} for f in found]
                     for b, found in self._write(name, entry, self._rows(name, entry)).items()}
            if self._publish(version + 1, base | {name: entry | {"parts": parts, "tombstones": []}}):
                return version + 1
        raise RuntimeError(f"{self.root}: 20 commits by others came first")
