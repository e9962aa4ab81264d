"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` of the session names the folder.  Only where it is
unset (tests, notebooks) a local temporary folder is taken, and only with a
local master.  A table written here cuts the lineage: what follows reads
files, so a lost executor never costs an earlier stage, and the files are
compressed and columnar, unlike those of ``checkpoint()``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .ship import ship


#: Setting that makes a query delete its shuffle files at its end.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tracemill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """A folder of intermediate tables of one operator call.

    ``save`` writes a DataFrame and returns one that reads the files; ``drop``
    deletes a table that no later plan reads.  What is left goes when the
    Python process ends.  With ``lean`` the shuffle files of a table go as soon
    as it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False):
        ship(spark)
        self.spark, self.lean = spark, lean
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with self._freed() if self.lean else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def save_counted(self, df: DataFrame, name: str, of: str = "true") -> tuple[DataFrame, int]:
        """``save``, and the number of rows where ``of`` holds, which comes with the write and costs no job of its own."""
        seen = Observation()
        return self.save(df.observe(seen, F.count_if(F.expr(of)).alias("rows")), name), seen.get["rows"]

    @contextlib.contextmanager
    def _freed(self) -> Iterator[None]:
        """Queries run here delete their shuffle files at their end; the setting of the session is as before afterwards."""
        before = self.spark.conf.get(_FREED, None)
        self.spark.conf.set(_FREED, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_FREED)
            else:
                self.spark.conf.set(_FREED, before)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass
