"""Cutting lineage with written tables in the shared checkpoint folder.

Iterative operators write each round to Parquet in the folder that
`spark.checkpoint.dir` names and go on from the reread table. The files live
outside any executor, so a lost executor costs a rerun of its tasks only.
"""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import ClassVar, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode one of our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="weft-")
        return _LOCAL_ROOT[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below a path and when it was last changed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength(), files.getFileStatus(target).getModificationTime()


#: Writes that are under way at once: a small table's is mostly waiting, and a large one's last tasks leave executors idle.
AT_ONCE = 8


def together(spark: SparkSession, jobs: Sequence[Callable[[], T]]) -> list[T]:
    """The results of jobs that don't depend on each other, run beside each other; the first error is raised once all have ended."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


#: What an application stores once and asks again.
_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, tables: Sequence[str], name: str, make: Callable[[Scratch], T]) -> T:
    """What `make` makes of some tables (their paths), made anew when one of them has changed."""
    key = (spark.sparkContext.applicationId, name, *((t, stamp(spark, t)) for t in tables))
    if key not in _STORED:
        _STORED[key] = make(Scratch(spark, name))
    return _STORED[key]


class Scratch:
    """The written tables of one query run, in a folder of their own.

    `put` writes a table and returns the reread one; `drop` deletes a table that
    no later step reads, `release` all tables of the runs that the same thread began
    after a `mark`, so that runs of other threads keep theirs. What is left goes when
    the driver ends.
    """

    _open: ClassVar[list[Scratch]] = []
    _serials: ClassVar[Iterator[int]] = itertools.count()

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.home = f"{scratch_root(spark)}/weft/{label}-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)
        self._owner, self._serial = threading.get_ident(), next(self._serials)
        self._open.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.home}/{next(self._numbers):03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The same with the number of rows, which the write itself observes."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._weft_path)

    @classmethod
    def mark(cls) -> int:
        return next(cls._serials)

    @classmethod
    def release(cls, since: int) -> None:
        """Deletes the tables of the runs that this thread began since the mark, once nothing reads them any more."""
        for run in [x for x in cls._open if x._serial > since and x._owner == threading.get_ident()]:
            cls._open.remove(run)
            delete(run.spark, run.home)


@atexit.register
def _close() -> None:
    for run in Scratch._open:
        try:
            delete(run.spark, run.home)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
