"""I8: incremental ingest. A file stream over the archive is extracted, normalized and merged batch by batch.

A store is a log of versions over runs. A run holds what one batch brought to one table: observations, or entities and
relationships folded within the batch. A batch only adds runs, so that it costs by its own size; since the folds are
associative, a read folds the runs again, the first one's raw values and attributes staying. Runs of one level are
merged to one of the next once there are FAN of them side by side: a row is rewritten once a level, and a table of any
size is a few runs a level. A run lies in buckets by a hash of its key, twice as many whenever it is twice as large, so a
batch that looks for its own observations (a replay) reads the buckets of its jobs only.

A version is one small file that must not be there before: it names the runs that it adds and drops. Every CHECKPOINT
versions the whole state is written beside it, so that readers take the last one and what follows. A writer that comes
second commits the same files as the next version, unless the first one brought some of its observations; then it takes
back what it wrote and starts again. `vacuum` removes what no version names any more, after a time of grace."""

from __future__ import annotations

import json
import random
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest, only_new, settled
from ..schema import TABLES
from ..sources.extract import extract_all, extract_archive
from ..storage import cut

_ARCHIVE = "path string, modificationTime timestamp, length long, content binary"
KEYS = {"observation": "job_id", "entity": "entity_id", "relationship": "rel_id"}
#: Runs of a level that make one of the next, and versions from one checkpoint to the next.
FAN, CHECKPOINT = 8, 16
#: Rows of a bucket, from which on a run has twice as many buckets.
BUCKET_ROWS = 1 << 20
#: Stores whose objects appear whole and can be created on the condition that there is none.
OBJECT_STORES = ("s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


class Conflict(Exception):
    """Another writer has made this version, or did so too often."""


@dataclass
class Run:
    """What a version added to a table: `at` is the first version whose rows it holds, `bits` the log2 of its buckets."""

    table: str
    path: str
    rows: int
    bits: int
    at: int
    level: int = 0


@dataclass
class State:
    version: int = -1
    runs: list[Run] = field(default_factory=list)

    def of(self, table: str) -> list[Run]:
        return sorted((r for r in self.runs if r.table == table), key=lambda r: r.at)

    def then(self, version: int, entry: dict) -> State:
        gone = set(entry["drop"])
        return State(version, [r for r in self.runs if r.path not in gone] + [Run(**r) for r in entry["add"]])


class Store:
    """The merged tables under one folder. A run has as many buckets as its rows ask for, `buckets` at least."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1, bucket_rows: int = BUCKET_ROWS, fan: int = FAN, checkpoint: int = CHECKPOINT):
        self.spark, self.root, self.buckets, self.bucket_rows, self.fan, self.checkpoint = spark, root.rstrip("/"), buckets, bucket_rows, fan, checkpoint

    # -- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, age in seconds) of what is in a folder."""
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(path)]

    def _read_json(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, name: str, content: dict) -> None:
        """Makes a file whole and at once; Conflict if there is one of that name."""
        fs, final = self._fs(), self._path(name)
        jvm, data = self.spark._jvm, json.dumps(content).encode()
        try:
            if fs.getScheme() in OBJECT_STORES:
                out = fs.createFile(final).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
                out.write(data)
                out.close()  # the object appears here, or not at all
                return
            ready = self._path(f"versions/_{uuid.uuid4().hex}")
            out = fs.create(ready, False)
            out.write(data)
            out.close()
            try:
                if fs.getScheme() == "file":  # a hard link fails where a rename would replace
                    at = lambda p: jvm.java.nio.file.Paths.get(p.toUri())
                    jvm.java.nio.file.Files.createLink(at(fs.makeQualified(final)), at(fs.makeQualified(ready)))
                else:
                    none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri()).rename(ready, final, none)
            finally:
                fs.delete(ready, False)
        except Exception as e:
            if self._is_there_already(e):
                raise Conflict(name) from e
            raise

    @staticmethod
    def _is_there_already(e: Exception) -> bool:
        found = getattr(e, "java_exception", None)
        while found is not None:
            kind = found.getClass()
            while kind is not None:
                if kind.getName() in ("java.nio.file.FileAlreadyExistsException", "org.apache.hadoop.fs.FileAlreadyExistsException"):
                    return True
                kind = kind.getSuperclass()
            found = found.getCause()
        return False

    # -- versions

    def version(self) -> int:
        return max((int(n) for n, _ in self._listed("versions") if n.isdigit()), default=-1)

    def state(self) -> State:
        """The newest version: the last checkpoint and what follows it."""
        names = [n for n, _ in self._listed("versions")]
        last = max((int(n.partition(".")[0]) for n in names if n.endswith(".checkpoint")), default=None)
        state = State()
        if last is not None:
            state = State(last, [Run(**r) for r in self._read_json(f"versions/{last:012d}.checkpoint")["runs"]])
        for n in sorted(int(n) for n in names if n.isdigit()):
            if n > state.version:
                state = state.then(n, self._read_json(f"versions/{n:012d}"))
        return state

    def commit(self, state: State, add: list[Run], drop: list[str] = ()) -> State:
        """Makes the version after `state`; Conflict if there is one already."""
        version = state.version + 1
        self._fs().mkdirs(self._path("versions"))
        entry = {"add": [r.__dict__ for r in add], "drop": list(drop)}
        self._create(f"versions/{version:012d}", entry)
        new = state.then(version, entry)
        if version % self.checkpoint == self.checkpoint - 1:
            self._create(f"versions/{version:012d}.checkpoint", {"runs": [r.__dict__ for r in new.runs]})
        return new

    # -- runs

    def _bucket(self, table: str, bits: int) -> Column:
        return F.expr(f"cast(xxhash64({KEYS[table]}) & {(1 << bits) - 1}L as int)")

    def write(self, table: str, df: DataFrame, at: int, level: int = 0) -> list[Run]:
        """A run of the rows, in buckets by their number; none of no rows. `df` is read twice."""
        rows = df.count()
        if not rows:
            return []
        bits = (max(self.buckets, -(-rows // self.bucket_rows)) - 1).bit_length()
        path = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        placed = df.select(*columns).withColumn("_bucket", self._bucket(table, bits)).repartition(1 << bits, "_bucket")
        placed.sortWithinPartitions("_bucket", KEYS[table]).write.partitionBy("_bucket").parquet(path)
        return [Run(table, path, rows, bits, at, level)]

    def discard(self, runs: list[Run]) -> None:
        for r in runs:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(r.path), True)

    def _rows(self, run: Run, keys: set[int] | None = None, key_bits: int = 0) -> DataFrame:
        """A run's rows, or of the buckets alone where hashes of `keys` fall (their last key_bits bits)."""
        rows = self.spark.read.schema(f"{TABLES[run.table]}, _bucket int").parquet(run.path)
        if keys is not None and run.bits:
            mask = (1 << min(run.bits, key_bits)) - 1
            rows = rows.where((F.col("_bucket").bitwiseAND(mask)).isin(sorted({k & mask for k in keys})))
        return rows.drop("_bucket")

    def folded(self, runs: list[Run]) -> DataFrame:
        """The rows of some runs of one table, as one."""
        table = runs[0].table
        every = reduce(DataFrame.unionByName, [self._rows(r).withColumn("_at", F.lit(r.at)) for r in runs])
        if table == "observation" or len(runs) == 1:
            return every.drop("_at")
        key = ["entity_id", "inv_id", "type", "norm"] if table == "entity" else ["rel_id", "inv_id", "src_id", "dst_id", "type"]
        kept = ["raw", "attrs"] if table == "entity" else ["attrs"]
        sums = [F.sum("obs_count").alias("obs_count")] if table == "entity" else []
        return every.groupBy(*key).agg(*[F.min_by(c, "_at").alias(c) for c in kept], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *sums)

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """A table at the newest version or at one that is given."""
        runs = (state or self.state()).of(table)
        return self.folded(runs) if runs else self.spark.createDataFrame([], TABLES[table])

    def seen(self, runs: list[Run], own_jobs: DataFrame) -> DataFrame:
        """obs_id of the observations in some runs that may be of the jobs: those of the jobs' buckets."""
        bits = max((r.bits for r in runs), default=0)
        keys = {r[0] for r in own_jobs.select(self._bucket("observation", bits)).distinct().collect()} if bits else set()  # as many as buckets at most
        none = self.spark.createDataFrame([], "obs_id string")
        return reduce(DataFrame.unionByName, [self._rows(r, keys, bits).select("obs_id") for r in runs], none)

    # -- upkeep

    def compact(self) -> State:
        """Merges runs while a level has FAN of them side by side. Of two that merge the same runs one is given up."""
        state = self.state()
        while found := next((x for t in KEYS if (x := self._full(state.of(t)))), None):
            merged = self.write(found[0].table, cut(self.folded(found)), found[0].at, found[0].level + 1)
            gone = [r.path for r in found]
            while True:
                try:
                    state = self.commit(state, merged, gone)
                    break
                except Conflict:
                    state = self.state()
                    if not set(gone) <= {r.path for r in state.runs}:
                        self.discard(merged)
                        break
        return state

    def _full(self, runs: list[Run]) -> list[Run] | None:
        """The oldest FAN runs side by side of one level."""
        for k in range(len(runs) - self.fan + 1):
            some = runs[k : k + self.fan]
            if len({r.level for r in some}) == 1:
                return some
        return None

    def vacuum(self, grace_s: float = 86_400) -> int:
        """Deletes data that no version names and old log entries before the last checkpoint, if older than the grace that
        running readers and writers need; returns how many."""
        state = self.state()
        named, fs, gone = {r.path.rpartition("/")[2] for r in state.runs}, self._fs(), 0
        for name, age in self._listed("data"):
            if name not in named and age > grace_s:
                gone += bool(fs.delete(self._path(f"data/{name}"), True))
        entries = self._listed("versions")
        last = max((int(n.partition(".")[0]) for n, _ in entries if n.endswith(".checkpoint")), default=-1)
        for name, age in entries:
            number = name.partition(".")[0]
            if age > grace_s and (not number.isdigit() or int(number) < last):
                gone += bool(fs.delete(self._path(f"versions/{name}"), False))
        return gone


def merge_parsed(store: Store, parsed: DataFrame, jobs: DataFrame, tries: int = 50) -> State:
    """Merges one batch of parsed observations as one version. The batch is made once; only if another writer has brought
    some of its observations meanwhile is it made again. Gives up with Conflict after so many tries."""
    parsed = cut(parsed)
    own_jobs = parsed.select("job_id").distinct()
    state = store.state()
    for fresh in range(tries):
        new = settled(ingest(only_new(parsed, store.seen(state.of("observation"), own_jobs)), jobs))
        at = state.version + 1
        runs = [r for table, df in (("observation", new.observations), ("entity", new.entities), ("relationship", new.relationships)) for r in store.write(table, df, at)]
        for again in range(tries - fresh):
            for r in runs:
                r.at = state.version + 1
            try:
                return store.commit(state, runs) if runs else state
            except Conflict:
                known = {r.path for r in state.runs}
                state = store.state()
                later = [r for r in state.of("observation") if r.path not in known]
                if later and not new.observations.join(store.seen(later, own_jobs), "obs_id", "left_semi").isEmpty():
                    break
                time.sleep(random.random() * min(2.0, 0.05 * 2**again))
        store.discard(runs)
    raise Conflict(f"given up after {tries} tries")


def merge_batch(store: Store, archive: DataFrame, jobs: DataFrame) -> None:
    """Extracts and merges one batch of archived outputs, then merges runs where there are many."""
    merge_parsed(store, extract_all(archive, jobs), jobs)
    store.compact()


def merge_files(store: Store, paths: list[str], jobs: DataFrame) -> None:
    """Extracts and merges archived files, large bodies in splits, then merges runs where there are many."""
    if paths:
        merge_parsed(store, extract_archive(store.spark, paths, jobs), jobs)
        store.compact()


def stream_archive(spark: SparkSession, root: str, jobs: DataFrame, store: Store, checkpoint: str, files_at_once: int = 10_000) -> StreamingQuery:
    """Watches {root}/{job_id}/output.* and merges what has arrived, at most so many files a batch; stops when all that is
    there is merged. The stream carries names only, so that no body has to fit a row."""
    options = {"pathGlobFilter": "output.*", "recursiveFileLookup": "true", "maxFilesPerTrigger": str(files_at_once)}
    names = spark.readStream.format("binaryFile").schema(_ARCHIVE).options(**options).load(root).select("path")
    merge = lambda df, _: merge_files(store, [r["path"] for r in df.collect()], jobs)  # noqa: E731  bounded by files_at_once
    return names.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
