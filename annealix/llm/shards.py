"""Immutable shards with size-tiered compaction and versioned manifests (operator 9).

``append`` writes arrivals as they come: every task leaves one small file, none
is ever changed. A file of b bytes is of tier floor(log_fanout(b / smallest)).
``compact`` takes a tier that has at least ``fanout`` files under the target
size and rewrites them as about total / target files. The files of one tier
are of like size, so merging them by number (``coalesce``, without a shuffle)
gives files of like size too, and no row is rewritten more than once per tier.

Every change is a new manifest: a table of the live files, written first, and
then a version file that names it, moved into place without overwriting. The
move is the commit. Readers see a whole version or none; of two writers one
fails and tries again on top of the other. Old versions stay readable until
``vacuum``, which never removes what a writer has not committed yet: of the
folders no kept version names, those that a removed version names go at once,
and those that no version ever named only after a period of grace.

Rows are stored as they are: nulls, ties, repeats, very long texts and columns
of any name stay. An empty arrival commits a version without new files.
Built-in functions only; the driver handles names of versions and, as Spark's
own file index does, one path per live file.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, folder string, bytes long, rows long, tier int, added long"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 64 << 20, smallest_bytes: int = 1 << 20, fanout: int = 4):
        if fanout < 2 or not 0 < smallest_bytes <= target_bytes:
            raise ValueError("fanout must be at least 2 and smallest_bytes at most target_bytes")
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.smallest, self.fanout = target_bytes, smallest_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files and versions

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def version(self) -> int:
        """The last committed version; 0 for a new store."""
        fs, folder = self._fs(), self._path("versions")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def _manifest_folder(self, version: int) -> str:
        stream = self._fs().open(self._path("versions", f"{version:012d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live files of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._manifest_folder(version)}")

    def _commit(self, base: int, live: DataFrame, folder: str | None = None) -> int:
        """Write ``live`` as the manifest after ``base``. Raises Conflict if that version exists.

        ``folder`` holds the files that are new in it and must still be there.
        """
        name, version = uuid.uuid4().hex, base + 1
        if folder is not None and not self._fs().exists(self._path("data", folder)):
            raise FileNotFoundError(f"{self.root}/data/{folder} was removed before its commit")
        live.coalesce(8).write.parquet(f"{self.root}/manifests/{name}")
        fs = self._fs()
        fs.mkdirs(self._path("versions"))
        tmp = self._path("versions", f".{name}")
        out = fs.create(tmp, False)
        out.writeUTF(name)
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            context.rename(tmp, self._path("versions", f"{version:012d}"), options)
        except Exception as e:
            fs.delete(tmp, False)
            raise Conflict(f"version {version} exists") from e
        return version

    def _listed(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in a folder that have rows."""
        tier = F.greatest(F.floor(F.log(F.col("bytes") / self.smallest) / math.log(self.fanout)), F.lit(0)).cast("int")
        meta = F.col("_metadata")
        files = self.spark.read.schema("nothing_at_all int").parquet(f"{self.root}/data/{folder}").groupBy(meta["file_path"].alias("path")).agg(F.max(meta["file_size"]).alias("bytes"), F.count("*").alias("rows"))
        return files.select("path", F.lit(folder).alias("folder"), "bytes", "rows", tier.alias("tier"), F.lit(version).cast("long").alias("added"))

    # Operations

    def append(self, rows: DataFrame) -> int:
        """Write the rows as small shards and commit them, on top of any other writer. Returns the version."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{folder}")
        while True:
            base = self.version()
            try:
                return self._commit(base, self.manifest(base).unionByName(self._listed(folder, base + 1)), folder)
            except Conflict:
                continue

    def compact(self) -> list[int]:
        """Merge runs of like size until no tier has ``fanout`` files under the target. Returns the versions made."""
        made = []
        while True:
            base = self.version()
            live = self.manifest(base)
            due = live.where(F.col("bytes") < self.target * 0.75).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if due is None:
                return made
            run = live.where((F.col("tier") == due.tier) & (F.col("bytes") < self.target * 0.75))
            paths = [r.path for r in run.select("path").collect()]
            parts = max(1, round(due.bytes / self.target))
            if parts >= due.n:
                return made
            folder = uuid.uuid4().hex
            self.spark.read.option("mergeSchema", True).parquet(*paths).coalesce(parts).write.parquet(f"{self.root}/data/{folder}")
            kept = live.join(run.select("path"), "path", "left_anti").select(*live.columns)
            try:
                made.append(self._commit(base, kept.unionByName(self._listed(folder, base + 1)), folder))
            except Conflict:  # the run may have changed; choose again
                self._fs().delete(self._path("data", folder), True)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema or "nothing int")
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*paths)

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400) -> None:
        """Delete versions but the last ``keep``, what only they name, and older leftovers of writers that failed."""
        last, fs = self.version(), self._fs()
        every = sorted(int(s.getPath().getName()) for s in (fs.listStatus(self._path("versions")) if last else []) if s.getPath().getName().isdigit())
        kept = [v for v in every if v > last - keep]
        named: dict[bool, set[str]] = {True: set(), False: set()}
        manifests: dict[bool, set[str]] = {True: set(), False: set()}
        for v in every:
            manifests[v in kept].add(self._manifest_folder(v))
            named[v in kept] |= {r.folder for r in self.manifest(v).select("folder").distinct().collect()}
        for v in set(every) - set(kept):
            fs.delete(self._path("versions", f"{v:012d}"), False)
        edge = (time.time() - grace_seconds) * 1000
        for top, names in (("data", named), ("manifests", manifests)):
            if fs.exists(self._path(top)):
                for s in fs.listStatus(self._path(top)):
                    name = s.getPath().getName()
                    if name not in names[True] and (name in names[False] or s.getModificationTime() < edge):
                        fs.delete(s.getPath(), True)


def ingest(docs: DataFrame, root: str, *, arrival: F.Column | None = None, arrivals: int = 4, keep: int = 2, **sizes) -> ShardStore:
    """Append ``arrivals`` batches (rows by the number in ``arrival``), compacting after each; the last ``keep`` versions stay readable."""
    store = ShardStore(docs.sparkSession, root, **sizes)
    number = F.lit(0) if arrival is None else arrival
    for n in range(arrivals):
        store.append(docs.where(number == n))
        store.compact()
        store.vacuum(keep)
    return store
