"""Stored tables and lookup files: Parquet catalog, CSV, SQLite, language list, snapshots (SRC-06 to SRC-09, SRC-17, SNK-03 to SNK-06)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.operators.store import get_or_create, repeated_keys, with_references
from quillgraph.runtime import Stage
from quillgraph.schema import KEYS, REFERENCES, SCHEMAS


class Catalog:
    """Tables of the graph as Parquet folders under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table; one that was never written has no rows."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def store(self, table: str, incoming: DataFrame) -> int:
        """Appends the rows whose natural key isn't stored; how many these were."""
        stage = Stage(self.spark)
        try:
            fresh = get_or_create(self.read(table), incoming, KEYS[table], stage=stage)
            fresh = fresh.select(*(F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]))
            seen = Observation()
            fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path(table))
            return seen.get.get("n") or 0
        finally:
            stage.close()

    def store_natural(self, table: str, rows: DataFrame) -> int:
        """`store` of rows that name what they refer to by natural keys; these tables must have been stored before."""
        return self.store(table, with_references(rows, REFERENCES[table], self.read).select(*(c for c in SCHEMAS[table].names if c in {*rows.columns, *REFERENCES[table]})))

    def check(self, table: str) -> DataFrame:
        return repeated_keys(self.read(table), KEYS[table])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; columns without a name are dropped."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.select(*(f"`{c}`" for c in df.columns if c.strip() and not re.fullmatch(r"_c\d+|Unnamed.*", c)))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for samples and reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def rendered(df: DataFrame, form: str = "markdown", most: int = 1000) -> str:
    """A small report as a `markdown`, `html` or `latex` table; refuses one of more than `most` rows (SNK-07)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cells = [df.columns, *(["" if x is None else str(x) for x in r] for r in rows)]
    if form == "html":
        safe = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{safe(x)}</{tag}>" for x in r) + "</tr>"
        return "<table>" + line(cells[0], "th") + "".join(line(r, "td") for r in cells[1:]) + "</table>"
    if form == "latex":
        safe = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x)
        body = [" & ".join(map(safe, r)) + r" \\" for r in cells]
        return "\n".join([r"\begin{tabular}{" + "l" * len(cells[0]) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * len(cells[0]), *cells[1:]])


def write_errors(errors: DataFrame, root: str, batch: int) -> None:
    errors.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def latest_snapshot(names: list[str]) -> str | None:
    """The newest of folder names that are dates; others are ignored (SRC-17)."""
    return max((n for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n.strip("/"))), default=None)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_snapshot(spark: SparkSession, root: str, table: str, newer_than: str | None = None, force: bool = False) -> DataFrame | None:
    """A table of the newest dated folder under `root`; None if none is newer than a known date, unless forced (SRC-17)."""
    fs, p = _folder(spark, root)
    newest = latest_snapshot([f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]) if fs.exists(p) else None
    if newest is None or newer_than is not None and newest <= newer_than and not force:
        return None
    return spark.read.parquet(f"{root}/{newest}/{table}")


def write_snapshot(catalog: Catalog, root: str, date: str, skip: tuple[str, ...] = ("metadata",)) -> list[str]:
    """Copies all tables of a catalog to the folder of a date, but for those to skip; the names of the copied ones (SNK-06)."""
    if latest_snapshot([date]) is None:
        raise ValueError(f"{date} is no date")
    copied = [t for t in SCHEMAS if t not in skip]
    for t in copied:
        catalog.read(t).write.mode("overwrite").parquet(f"{root}/{date}/{t}")
    return copied


def credentials(path: str, key: str) -> list[str]:
    """The list under `key` of a small YAML file of e-mails or tokens; they can be dealt out with `round_robin` (SRC-20)."""
    found, inside = [], False
    with open(path) as f:
        for line in f:
            if re.match(r"\S.*:", line):
                inside = line.split(":")[0].strip() == key
            elif inside and (m := re.match(r"""\s*-\s*["']?(.*?)["']?\s*$""", line)):
                found.append(m.group(1))
    return found


def programming_languages(spark: SparkSession, path: str) -> DataFrame:
    """Names of type `programming` in a YAML list of languages: a top-level key starts an entry, its
    `type:` line tells the kind. Read as text, no YAML library is needed (SRC-09)."""
    names, current = [], None
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()  # one small lookup file
    for line in lines:
        if m := re.match(r"""(["']?)([^\s#"'][^"']*?)\1:\s*$""", line):
            current = m.group(2)
        elif (m := re.match(r"\s+type:\s*(\w+)", line)) and m.group(1) == "programming" and current:
            names.append((current,))
    return spark.createDataFrame(names, "language string")


class SqliteSource(DataSource):
    """`spark.read.format("sqlite")` with options path, table, and partitions (ranges of rowid)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "BIGINT": "bigint", "FLOAT": "double", "REAL": "double", "BOOLEAN": "boolean", "DATE": "string", "DATETIME": "string"}
        with sqlite3.connect(f"file:{os.path.abspath(self.options['path'])}?mode=ro", uri=True) as con:
            rows = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper().split('(')[0], 'string')}" for r in rows)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.n, self.schema = os.path.abspath(options["path"]), options["table"], int(options.get("partitions", "1")), schema

    def partitions(self):
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.n))
        return [InputPartition((a, min(a + step, high + 1))) for a in range(low, high + 1, step)]

    def read(self, partition):
        import sqlite3

        names = ", ".join(f'"{f.name}"' for f in self.schema)
        flags = [i for i, f in enumerate(self.schema) if f.dataType.typeName() == "boolean"]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value):
                yield tuple(bool(v) if i in flags and v is not None else v for i, v in enumerate(row))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions)).load()
