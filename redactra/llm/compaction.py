"""Sharding by size-tiered compaction: immutable shards, merges of similar sizes, atomically committed manifests.

A store is a folder: ``data/<run>/`` holds one immutable run of Parquet shards, ``manifest/<version>.json`` lists the live
runs. Arrivals are appended as small runs. Runs whose sizes fall into one tier (powers of ``fanout`` above the smallest
shard) merge, when there are ``fanout`` of them, into one run of files near the target size, which enters a higher tier;
each row is so rewritten about log(size) times. A run whose files are too large for the target is rewritten into more of
them. Runs with files near the target are never touched again. Merges of one round run side by side and are committed at once.

``ingest`` cuts a table into arrivals bounded by bytes, so their number grows with the table: all are written in one job
without a shuffle, in files bounded by the mean size of a row, and enter the store in order, a share at a time.

A commit writes the next manifest under a temporary name and renames it; the rename fails if that version exists, so of
two writers one wins and the other starts again from the newer version. Readers see one version as a whole. A job that
dies leaves files that no manifest lists, which ``vacuum`` removes when they are old; a reader keeps the former version. All file work goes through Spark and Hadoop's file
system, so any shared store will do.

Defined results: an empty arrival commits nothing; reading a store without a manifest gives an error that says so;
repeated rows stay; columns are those of all arrivals, by name whatever its case, with the type that each came with first;
rows of arrivals without a column have nulls there.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET, SMALLEST, FANOUT = 64 << 20, 1 << 20, 4
#: Types whose values have at most 8 bytes.
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}
#: Merges that run at once.
MERGES = 8


@dataclass(frozen=True)
class Run:
    """An immutable group of shards."""

    path: str
    rows: int
    size: int
    files: int
    level: int
    arrivals: tuple[int, int]  # first and last arrival whose rows it may hold


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    arrivals: int
    runs: tuple[Run, ...]

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(x["version"], x["schema"], x["arrivals"], tuple(Run(**(r | {"arrivals": tuple(r["arrivals"])})) for r in x["runs"]))


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target, smallest, fanout
        self.jvm = spark.sparkContext._jvm
        self.short: set[str] = set()  # runs that came out with fewer files than asked for: no rewrite makes more of them
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list:
        p = self._path(path)
        return list(self.fs.listStatus(p)) if self.fs.exists(p) else []

    def tier(self, size: int) -> int:
        """0 up to the smallest size; each next tier is ``fanout`` times as large."""
        t, bound = 0, self.smallest
        while size > bound:
            t, bound = t + 1, bound * self.fanout
        return t

    # Manifests.

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._list(f"{self.root}/manifest")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The given or the newest version; None for a new store."""
        have = self.versions()
        if version is None:
            if not have:
                return None
            version = have[-1]
        elif version not in have:
            raise ValueError(f"no version {version} in {self.root}")
        source = self.fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return Manifest.parse(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def commit(self, new: Manifest) -> Manifest:
        """All or nothing: the rename doesn't replace an existing version."""
        folder = f"{self.root}/manifest"
        self.fs.mkdirs(self._path(folder))
        final, temp = self._path(f"{folder}/{new.version:012d}.json"), self._path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, False)
        out.write(bytearray(new.text().encode()))
        out.close()
        # Rename onto an existing file is refused by HDFS; local file systems replace it, so look first.
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise Conflict(f"version {new.version} exists")
        return new

    # Runs.

    def _write(self, df: DataFrame, files: int, level: int, arrivals: tuple[int, int], even: bool = False) -> Run | None:
        """``even`` deals the rows evenly to the files, by a shuffle."""
        path = f"data/{uuid.uuid4().hex}"
        (df.repartition(files) if even else df.coalesce(files)).write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        shards = [f for f in self._list(f"{self.root}/{path}") if f.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()
        if not rows:
            self.fs.delete(self._path(f"{self.root}/{path}"), True)
            return None
        if even and len(shards) < files:
            self.short.add(path)
        return Run(path, rows, sum(f.getLen() for f in shards), len(shards), level, arrivals)

    def _kind(self, before: Manifest | None, new: StructType) -> StructType:
        """The stored columns, and after them those that ``new`` has beyond them; a column keeps the type that it came with."""
        if before is None:
            return new
        kind = StructType.fromJson(json.loads(before.schema))
        there = {f.name.lower() for f in kind}
        return StructType([*kind, *(f for f in new if f.name.lower() not in there)])

    def _as_stored(self, df: DataFrame, kind: StructType) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        return df.select(*((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))

    def _commit_runs(self, runs: list[Run], kind: StructType, tries: int) -> Manifest | None:
        """Commits each run as an arrival of its own, in one version."""
        for _ in range(tries):
            now = self.manifest()
            if not runs:
                return now
            n, kind = now.arrivals if now else 0, self._kind(now, kind)
            new = (replace(r, arrivals=(n + i, n + i)) for i, r in enumerate(runs))
            try:
                return self.commit(Manifest((now.version if now else 0) + 1, json.dumps(kind.jsonValue()), n + len(runs), (*(now.runs if now else ()), *new)))
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    def append(self, df: DataFrame, files: int = 1, tries: int = 5) -> Manifest | None:
        """Adds one arrival as a small run and commits it."""
        kind = self._kind(self.manifest(), df.schema)
        run = self._write(self._as_stored(df, kind), files, 0, (0, 0))
        return self._commit_runs([run] if run else [], kind, tries)

    def stage(self, df: DataFrame, most: int, batches: int) -> tuple[str, list[list[tuple[str, int, int]]]]:
        """(folder, arrivals of files (name, rows, size)): ``df`` written once, cut into ``batches`` arrivals or more.

        An arrival has files of at most ``most`` bytes together, or one file. Files are bounded by rows, as many as have
        ``most`` bytes at the mean size before compression; a file that is larger, as its rows are, is left to ``compact``.
        """
        same = self._as_stored(df, self._kind(self.manifest(), df.schema))
        width = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if f.dataType.simpleString() not in _FIXED else F.lit(8) for f in same.schema), F.lit(0).cast("long"))
        rows, size = same.agg(F.count("*"), F.sum(width)).first()
        folder = f"{self.root}/stage/{uuid.uuid4().hex}"
        if not rows:
            return folder, []
        least = max(1, min(-(-rows // batches), rows * most // max(1, size)))
        same.write.option("compression", "zstd").option("maxRecordsPerFile", least).parquet(folder)
        held = dict(self.spark.read.schema(same.schema).parquet(folder).select(F.col("_metadata.file_name").alias("f")).groupBy("f").count().collect())
        files = sorted((f.getPath().getName(), held[f.getPath().getName()], f.getLen()) for f in self._list(folder) if f.getPath().getName() in held)
        bound = min(most, sum(f[2] for f in files) // batches)
        arrivals, full = [], 0
        for f in files:
            if not arrivals or full + f[2] > bound:
                arrivals.append([])
                full = 0
            arrivals[-1].append(f)
            full += f[2]
        return folder, arrivals

    def adopt(self, folder: str, arrivals: list[list[tuple[str, int, int]]], kind: StructType, tries: int = 5) -> Manifest | None:
        """Moves staged files into the store, a run for each arrival, and commits them in one version."""
        runs = []
        for files in arrivals:
            path = f"data/{uuid.uuid4().hex}"
            self.fs.mkdirs(self._path(f"{self.root}/{path}"))
            for name, _, _ in files:
                if not self.fs.rename(self._path(f"{folder}/{name}"), self._path(f"{self.root}/{path}/{name}")):
                    raise RuntimeError(f"{folder}/{name} can't be moved to {path}")
            runs.append(Run(path, sum(f[1] for f in files), sum(f[2] for f in files), len(files), 0, (0, 0)))
        return self._commit_runs(runs, self._kind(self.manifest(), kind), tries)

    def files(self, size: int) -> int:
        """How many files near the target hold ``size`` bytes."""
        return max(1, round(size / self.target))

    def candidates(self, now: Manifest) -> list[list[Run]]:
        """Groups to merge: of each tier with ``fanout`` runs well below the target, the oldest first, as many as one file near
        the target holds, so that no merge needs a shuffle; and alone, runs with files too large or too small for their size."""
        tiers: dict[int, list[Run]] = {}
        out = []
        for r in now.runs:
            if 4 * r.size < 3 * self.target:
                tiers.setdefault(self.tier(r.size), []).append(r)
            elif (min(r.rows, self.files(r.size)) > r.files and r.path not in self.short) or self.files(r.size) < r.files and 2 * r.size < self.target * r.files:
                out.append([r])
        for t in sorted(tiers):
            if len(tiers[t]) < self.fanout:
                continue
            groups: list[list[Run]] = [[]]
            for r in sorted(tiers[t], key=lambda r: r.arrivals):
                if len(groups[-1]) == 2 * self.fanout or 2 * (sum(x.size for x in groups[-1]) + r.size) > 3 * self.target:
                    groups.append([])
                groups[-1].append(r)
            # Two runs always fit; one that is left over waits for others.
            out.extend(g for g in groups if len(g) > 1)
        return out

    def merge(self, *groups: list[Run]) -> Manifest | None:
        """Merges each group of runs into files near the target size and commits; None if another writer was first."""
        now = self.manifest()

        def one(runs: list[Run]) -> Run:
            files = self.files(sum(r.size for r in runs))
            return self._write(self.read_runs(now, runs), files, max(r.level for r in runs) + 1, (min(r.arrivals[0] for r in runs), max(r.arrivals[1] for r in runs)), files > 1)

        with ThreadPoolExecutor(MERGES) as pool:
            made = list(pool.map(one, groups))
        now = self.manifest()
        live = {r.path for r in now.runs}
        done = [(g, new) for g, new in zip(groups, made, strict=True) if {r.path for r in g} <= live]
        gone = {r.path for g, _ in done for r in g}
        lost = made
        try:
            if done:
                at = self.commit(replace(now, version=now.version + 1, runs=(*(r for r in now.runs if r.path not in gone), *(new for _, new in done))))
                kept = {new.path for _, new in done}
                lost = [r for r in made if r.path not in kept]
                return at
        except Conflict:
            pass
        finally:
            for r in lost:
                self.fs.delete(self._path(f"{self.root}/{r.path}"), True)
        return None

    def compact(self, tries: int = 8) -> Manifest | None:
        """Merges until no tier is full and no file too large; gives up after ``tries`` merges in a row that others came before."""
        lost = 0
        while (now := self.manifest()) and (groups := self.candidates(now)):
            lost = 0 if self.merge(*groups) else lost + 1
            if lost == tries:
                raise Conflict(f"no merge in {tries} tries")
        return now

    def read_runs(self, at: Manifest, runs: list[Run] | tuple[Run, ...]) -> DataFrame:
        kind = StructType.fromJson(json.loads(at.schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{r.path}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version; file and run are in ``_metadata.file_path``."""
        at = self.manifest(version)
        if at is None:
            raise ValueError(f"no manifest in {self.root}")
        return self.read_runs(at, at.runs)

    def vacuum(self, keep: int = 2, age: float = 86_400.0) -> int:
        """Removes runs that none of the last ``keep`` versions lists; returns how many.

        A run that no version has ever listed may be another writer's, on its way: it goes once its folder hasn't changed for
        ``age`` seconds.
        """
        versions = {v: {r.path.split("/")[-1] for r in self.manifest(v).runs} for v in self.versions()}
        live = set().union(*(versions[v] for v in sorted(versions)[-keep:])) if versions else set()
        once = set().union(*versions.values()) if versions else set()
        old = (time.time() - age) * 1000
        dead = [f.getPath() for f in self._list(f"{self.root}/data") if (name := f.getPath().getName()) not in live and (name in once or f.getModificationTime() <= old)]
        for p in dead:
            self.fs.delete(p, True)
        return len(dead)


def ingest(df: DataFrame, root: str, batches: int = 12, **options) -> ShardStore:
    """Takes ``df`` in as ``batches`` arrivals or more, of a quarter of the target at most, compacting after each few, as a feed would."""
    store = ShardStore(df.sparkSession, root, **options)
    folder, arrivals = store.stage(df, max(1, store.target // 4), batches)
    # Few enough steps, so that a large table's merges run side by side and its manifests stay small.
    step = max(2 * store.fanout, -(-len(arrivals) // 8))
    try:
        for i in range(0, len(arrivals), step):
            store.adopt(folder, arrivals[i : i + step], df.schema)
            store.compact()
            store.vacuum()
    finally:
        store.fs.delete(store._path(folder), True)
    return store


def inventory(store: ShardStore, id_col: str = "doc_id", text_col: str = "text", id_kind: str = "long") -> DataFrame:
    """(id, text_sha256, shard, run_level, version) of every row, read back by the newest manifest; no rows without one."""
    at = store.manifest()
    if at is None:
        empty = f"{id_col} {id_kind}, text_sha256 string, shard string, run_level int, version int"
        return store.spark.createDataFrame([], empty)
    levels = F.create_map(*(F.lit(x) for r in at.runs for x in (r.path.split("/")[-1], r.level)))
    run = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return store.read().select(
        id_col,
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
        F.col("_metadata.file_name").alias("shard"),
        F.try_element_at(levels, run).alias("run_level"),
        F.lit(at.version).alias("version"),
    )
