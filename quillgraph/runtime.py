"""Session factory, shared staging folder and size checks used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, app: str = "quillgraph", **conf: str) -> SparkSession:
    """A session with the settings the queries expect (UTC, AQE, ANSI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where the session names none (local tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


class Stage:
    """Intermediate tables in the shared folder; they cut the lineage of iterations.

    A written table survives the loss of executors, is compressed and columnar, and keeps
    statistics for the planner. `drop` removes a table that nothing reads any more; what is
    left is removed when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[str, DataFrame]] = {}
        atexit.register(_remove, spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def save_counted(self, df: DataFrame, *more: Column) -> tuple:
        """The written table, its number of rows, and further sums (0 where there are no rows), all counted while it is written."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(more))))
        got = seen.get
        return out, got.get("n") or 0, *(got.get(f"c{i}") or 0 for i in range(len(more)))

    def close(self) -> None:
        """Removes all tables of this stage; nothing may read them any more."""
        self._paths.clear()
        _remove(self.spark, self.root)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path, _ = self._paths.pop(id(df), (None, None))
            if path:
                _remove(self.spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before
        pass
