"""Case store: versioned Parquet tables, latest rows, cascades, jobs and the audit trail.

Every write is an append of row versions; a read takes the last version of each
key.  A deletion is a version too.  Parquet has no updates, and this way writers
never rewrite what readers hold.

A table's files lie in generations.  Compaction writes the current rows as the
first file of a new generation and then names that one in the table's CURRENT
file; later writes append to it.  The generation before is kept until the next
compaction for those who still read it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime, timezone
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake import config
from tidewake.schema import CASE_TABLES, schema


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_id(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


def dumps(value: Any) -> str:
    return json.dumps(value, default=str, sort_keys=True)


def loads(text: str | None, default: Any = None) -> Any:
    """Parsed JSON, ``default`` for null or broken text."""
    try:
        return default if text is None else json.loads(text)
    except ValueError:
        return default


def newest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The last row of each key in the order given."""
    last = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


#: Appends to a table after which it is compacted.
MOST_APPENDS = 200


class Store:
    """Tables under one folder; ``ais_positions`` is large and partitioned by case, the rest are small.

    One store object writes to a folder at a time; any number may read.
    """

    def __init__(self, spark: SparkSession, root: str, background: bool = False, workers: int = 2):
        self.spark, self.root, self.background = spark, root.rstrip("/"), background
        self._clock = 0
        self._lock = Lock()
        self._tables = defaultdict(Lock)
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="job")
        self._pending: dict[str, Future] = {}
        self._appends: dict[str, int] = defaultdict(int)
        self.most_appends = MOST_APPENDS
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    # ---------------------------------------------------------------- files

    def _files(self, path: str):
        at = self._jvm_path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def remove(self, path: str) -> None:
        """Deletes a file or folder, if it is there."""
        files, at = self._files(path)
        files.delete(at, True)

    def generation(self, table: str) -> int:
        files, at = self._files(f"{self.root}/{table}/CURRENT")
        if not files.exists(at):
            return 0
        stream = files.open(at)
        try:
            return int(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, table: str, generation: int) -> None:
        """Names the generation to read; the file is replaced by a whole one."""
        files, at = self._files(f"{self.root}/{table}/CURRENT")
        draft = self._jvm_path(f"{self.root}/{table}/.CURRENT.draft")
        out = files.create(draft, True)
        out.write(bytearray(str(generation).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, at, options)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}/g{self.generation(table)}"

    def compact(self, table: str) -> None:
        """Leaves one version of each row; readers of the generation before aren't disturbed."""
        with self._tables[table]:
            old = self.generation(table)
            rows = self._raw(table)
            if not rows.columns or not self._files(f"{self.root}/{table}/g{old}")[0].exists(self._jvm_path(f"{self.root}/{table}/g{old}")):
                return
            if table == "ais_positions":
                rows = rows.join(self._gone(), "import_id", "left_anti").select(*rows.columns)
            elif table != "audit_log":
                rows = newest(rows, ["id"], "_version").where("not _deleted") if table != "ais_imports" else newest(rows, ["id"], "_version")
            to = f"{self.root}/{table}/g{old + 1}"
            self.remove(to)  # of a compaction that ended early
            if table == "ais_positions":
                rows.write.partitionBy("case_id").parquet(to)
            else:
                rows.coalesce(1).write.parquet(to)
            self._point(table, old + 1)
            self._appends[table] = 0
            if old > 0:
                self.remove(f"{self.root}/{table}/g{old - 1}")

    def _version(self) -> int:
        with self._lock:
            self._clock = max(self._clock + 1, time.time_ns())
            return self._clock

    def write(self, table: str, rows: list[dict[str, Any]] | DataFrame, deleted: bool = False) -> None:
        names = schema(table).names
        if isinstance(rows, list):
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema(table))
        rows = rows.select(*names).withColumn("_version", F.lit(self._version())).withColumn("_deleted", F.lit(deleted))
        writer = rows.write.mode("append")
        with self._tables[table]:  # two commits to one folder at a time remove each other's drafts
            (writer.partitionBy("case_id") if table == "ais_positions" else writer).parquet(self._path(table))
            self._appends[table] += 1
            full = self._appends[table] >= self.most_appends
        if full:
            self.compact(table)

    def _raw(self, table: str) -> DataFrame:
        kinds = schema(table).add("_version", "long").add("_deleted", "boolean")
        try:
            return self.spark.read.schema(kinds).parquet(self._path(table))
        except Exception as problem:  # a table that nothing was written to yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], kinds)

    def table(self, name: str) -> DataFrame:
        """Current rows: the last version of each id that isn't a deletion."""
        raw = self._raw(name)
        if name == "ais_positions":
            return raw.join(self._gone(), "import_id", "left_anti").select(*schema(name).names)
        if name == "audit_log":
            return raw.orderBy("_version").select(*schema(name).names)
        return newest(raw, ["id"], "_version").where("not _deleted").select(*schema(name).names)

    def _gone(self) -> DataFrame:
        """Imports that were deleted; their positions no longer count."""
        return self._raw("ais_imports").where("_deleted").select(F.col("id").alias("import_id")).distinct()

    def get(self, table: str, key: str) -> dict[str, Any]:
        found = self.table(table).where(F.col("id") == key).limit(1).collect()
        if not found:
            raise config.NotFound(f"{table} {key} not found")
        return found[0].asDict()

    def update(self, table: str, key: str, **values: Any) -> dict[str, Any]:
        row = self.get(table, key) | values
        self.write(table, [row])
        return row

    def latest(self, table: str, case_id: str, **equal: Any) -> dict[str, Any] | None:
        """The newest row of a case."""
        rows = self.table(table).where(F.col("case_id") == case_id)
        for k, v in equal.items():
            rows = rows.where(F.col(k) == v)
        found = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(1).collect()
        return found[0].asDict() if found else None

    def delete(self, table: str, condition) -> None:
        """Current rows under a condition become deletions."""
        self.write(table, self.table(table).where(condition), deleted=True)

    def delete_case(self, case_id: str) -> None:
        """A case and all that belongs to it: rows, positions and the folders that its rows name."""
        self.get("cases", case_id)
        folders = []
        for table, columns in (("scenes", ("asset_uri", "preview_uri")), ("env_fields", ("artifact_uri",)), ("hindcast_runs", ("artifact_uri",))):
            for r in self.table(table).where(F.col("case_id") == case_id).select(*columns).collect():
                folders += [x for x in r if x]
        for table in CASE_TABLES:
            if table not in ("ais_positions", "audit_log"):
                self.delete(table, F.col("case_id") == case_id)
        self.delete("cases", F.col("id") == case_id)
        with self._tables["ais_positions"]:
            self.remove(f"{self._path('ais_positions')}/case_id={case_id}")
        for folder in folders:
            if folder.startswith(f"{self.root}/"):
                self.remove(folder)

    def audit(self, case_id: str | None, action: str, detail: Any = None, actor: str = "analyst") -> None:
        self.write("audit_log", [{"case_id": case_id, "ts": now(), "actor": actor, "action": action, "detail": dumps(detail)}])

    # ---------------------------------------------------------------- jobs

    def run_job(self, kind: str, case_id: str | None, work: Callable[[Job], Any]) -> str:
        """Runs work under a job row: queued, running, then completed or failed.

        With ``background`` set the work goes to one of two threads and the
        job's id comes back at once; ``wait`` waits for its end.
        """
        job = Job(self, new_id("job"), case_id, kind)
        job.save("queued")
        if self.background:
            self._pending[job.id] = self._pool.submit(self._work, job, kind, work)
        else:
            self._work(job, kind, work)
        return job.id

    def _work(self, job: Job, kind: str, work: Callable[[Job], Any]) -> None:
        job.save("running")
        context = self.spark.sparkContext
        context.setJobGroup(job.id, kind)
        try:
            result = work(job)
            job.save("completed", progress=1.0, result=dumps(result))
        except Exception as problem:  # recorded for whoever polls the job
            job.save("failed", error=f"{type(problem).__name__}: {problem}")
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)

    def wait(self, job_id: str, seconds: float | None = None) -> dict[str, Any]:
        """The job's row once its work has ended."""
        if pending := self._pending.pop(job_id, None):
            pending.result(seconds)
        return self.get("jobs", job_id)


class Job:
    def __init__(self, store: Store, job_id: str, case_id: str | None, kind: str):
        self.store, self.id = store, job_id
        self.row: dict[str, Any] = {"id": job_id, "case_id": case_id, "kind": kind, "state": "queued", "progress": 0.0, "message": None, "result": None, "error": None, "created_at": now()}

    def save(self, state: str, **values: Any) -> None:
        self.row |= values | {"state": state, "updated_at": now()}
        self.store.write("jobs", [self.row])

    def progress(self, share: float, message: str | None = None) -> None:
        """Clamped to [0, 1]; the last message stays if there is no new one."""
        self.save("running", progress=max(0.0, min(1.0, share)), message=message or self.row["message"])


def case_list(store: Store) -> DataFrame:
    """Cases, newest first, each with its latest scene and number of slicks, in one plan."""
    return assembled(store.table("cases"), store.table("scenes"), store.table("slicks"))


def assembled(cases: DataFrame, scenes: DataFrame, slicks: DataFrame) -> DataFrame:
    scenes = scenes.groupBy("case_id").agg(F.max_by(F.struct("id", "acquisition_time"), F.struct("created_at", "id")).alias("s"))
    slicks = slicks.groupBy("case_id").agg(F.count("*").alias("n_slicks"))
    cases = cases.select(F.col("id").alias("case_id"), "name", "status", "data_mode", "created_at", "updated_at")
    out = cases.join(scenes, "case_id", "left").join(slicks, "case_id", "left")
    return out.select("case_id", "name", "status", "data_mode", "created_at", "updated_at", F.col("s.id").alias("scene_id"), F.col("s.acquisition_time").alias("acquisition_time"), F.coalesce("n_slicks", F.lit(0)).alias("n_slicks")).orderBy(F.desc("created_at"))
