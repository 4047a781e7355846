"""Sharding by size-tiered compaction, under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards below the target size are put in tiers by size; a
tier with enough of them is merged by one job without a shuffle into files near the target size, or into one run of
a higher tier. Each append and each merge commits the next version of the manifest: a JSON file of what it adds and drops, written
under a temporary name and renamed without overwriting, so of two writers one fails and tries again, and readers see a whole version
or none. After each SPAN versions a file lists all live shards, from which readers start; commits themselves write no more than their
own. A merge whose shards another writer took away deletes its files and looks anew. Old versions stay readable until vacuum().

The rename is atomic on HDFS and local file systems; on an object store without an atomic rename only one writer is safe.

Defined cases: an empty arrival commits a version without new shards; a store without rows reads as an empty
table of its schema; repeated rows, nulls, empty and very long texts are kept as they are; all columns of the arrivals are stored,
whatever their names; of tiers that are full the lowest is merged first.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _path, remove, shared_dir, table

#: Bytes of a file that is big enough to be left alone, of the lowest tier, and how many shards make a tier full.
TARGET_BYTES, LEAST_BYTES, FANOUT = 128 << 20, 1 << 20, 4
#: Versions from one list of all shards to the next.
SPAN = 64
#: Batches in which op7's documents arrive.
ARRIVALS = 4


class ShardStore:
    """Shards below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, least: int = LEAST_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.least, self.fanout = spark, root.rstrip("/"), target, least, fanout

    # ------------------------------------------------------------ manifest

    def _numbers(self, kind: str) -> list[int]:
        fs, p = _path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(name[1:-5]) for s in fs.listStatus(p) if (name := s.getPath().getName()).startswith(kind) and name.endswith(".json"))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def _name(self, kind: str, version: int) -> str:
        return f"{self.root}/manifest/{kind}{version:010d}.json"

    def _load(self, kind: str, version: int) -> dict:
        fs, p = _path(self.spark, self._name(kind, version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _save(self, kind: str, content: dict) -> None:
        """Writes a file as a whole, or FileExistsError if there is one of its name."""
        jvm = self.spark.sparkContext._jvm
        fs, tmp = _path(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(tmp.getParent())
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        to = jvm.org.apache.hadoop.fs.Path(self._name(kind, content["version"]))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(str(to)) from e
            raise

    def _list_all(self, m: dict) -> None:
        """Writes the list of all shards of a version, unless it is there."""
        try:
            self._save("l", m)
        except FileExistsError:
            pass

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and live shards: the last list of all shards up to the version, and the changes after it."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        lists = [n for n in self._numbers("l") if n <= version]
        m = self._load("l", lists[-1]) if lists else {"version": 0, "schema": None, "shards": []}
        live = {s["path"]: s for s in m["shards"]}
        for v in range(m["version"] + 1, version + 1):
            change = self._load("v", v)
            for path in change["drop"]:
                del live[path]
            live |= {s["path"]: s for s in change["add"]}
            m["schema"] = change["schema"]
        return {"version": version, "schema": m["schema"], "shards": list(live.values())}

    def _commit(self, old: dict, schema: StructType, add: list[dict], drop: set[str]) -> dict:
        """The next version, or FileExistsError if another writer was first."""
        new = {"version": old["version"] + 1, "schema": schema.json(), "shards": [s for s in old["shards"] if s["path"] not in drop] + add}
        self._save("v", {"version": new["version"], "schema": new["schema"], "add": add, "drop": sorted(drop)})
        if new["version"] % SPAN == 0:
            self._list_all(new)
        return new

    def commit(self, schema: StructType, add: list[dict], drop: set[str] = frozenset()) -> dict:
        """Commits on top of the latest version; a merge gives way if another writer has taken its shards away."""
        while True:
            old = self.manifest()
            if not drop <= {s["path"] for s in old["shards"]}:
                raise FileExistsError("the merged shards are no longer live")
            try:
                return self._commit(old, schema, add, drop)
            except FileExistsError:
                continue

    # ------------------------------------------------------------ data

    def _write(self, df: DataFrame) -> list[dict]:
        """Writes a folder of immutable files; their paths, relative to the root, and sizes."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        fs, p = _path(self.spark, f"{self.root}/{name}")
        files = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)]
        parts = [(f, n) for f, n in files if f.startswith("part-")]
        return [{"path": f"{name}/{f}", "bytes": n, "of": len(parts)} for f, n in parts]

    def _paths(self, shards: list[dict]) -> list[str]:
        """What is to be read for shards: whole folders where all their files are live, which is what a job wrote, else files."""
        folders: dict[str, list[dict]] = {}
        for s in shards:
            folders.setdefault(s["path"].rpartition("/")[0], []).append(s)
        out = []
        for folder, files in folders.items():
            out += [folder] if len(files) == files[0]["of"] else [s["path"] for s in files]
        return [f"{self.root}/{p}" for p in out]

    def append(self, df: DataFrame) -> dict:
        return self.commit(df.schema, self._write(df))

    def _tier(self, n: int) -> int:
        return max(0, int(math.log(max(n, 1) / self.least, self.fanout))) if n > self.least else 0

    def compact(self) -> int:
        """Merges full tiers, lowest first, until none is full; the number of merges."""
        merges = 0
        while True:
            m = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in m["shards"]:
                if s["bytes"] < self.target // 2:
                    tiers.setdefault(self._tier(s["bytes"]), []).append(s)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return merges
            run = tiers[full]
            schema = StructType.fromJson(json.loads(m["schema"]))
            n = max(1, round(sum(s["bytes"] for s in run) / self.target))
            new = self._write(self.spark.read.schema(schema).parquet(*self._paths(run)).coalesce(n))
            try:
                self.commit(schema, new, {s["path"] for s in run})
                merges += 1
            except FileExistsError:
                for folder in {s["path"].rpartition("/")[0] for s in new}:
                    remove(self.spark, f"{self.root}/{folder}")

    def vacuum(self) -> int:
        """Deletes shards and manifests that the latest version doesn't need; the number of files. Not while others write."""
        m = self.manifest()
        live = {s["path"] for s in m["shards"]}
        fs, p = _path(self.spark, f"{self.root}/data")
        gone = 0
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            for f in fs.listStatus(folder.getPath()):
                if f"data/{folder.getPath().getName()}/{f.getPath().getName()}" not in live:
                    fs.delete(f.getPath(), False)
                    gone += 1
            if not list(fs.listStatus(folder.getPath())):
                fs.delete(folder.getPath(), True)
        self._list_all(m)
        for kind in "vl":
            for v in self._numbers(kind):
                if v != m["version"]:
                    fs.delete(_path(self.spark, self._name(kind, v))[1], False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise FileNotFoundError(f"{self.root} has no manifest")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(m["shards"]))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches by a hash of their id, are merged to target-sized files, and are read by the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    text = F.col("text").cast("binary")
    return store.read().select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.sha2(text, 256).alias("text_sha256"))


OP7_SQL = "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS text_sha256 FROM documents"
