"""References to records that do not exist, with their descendants (problem 4)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import skew_join
from quillgraph.runtime import Stage


@dataclass(frozen=True)
class ForeignKey:
    """`table.column` refers to `target.target_column`."""

    table: str
    column: str
    target: str
    target_column: str = "id"


OUT = ["ref_table", "ref_column", "row_id", "created", "kind", "reason", "depth"]


def _references(tables: dict[str, DataFrame], fk: ForeignKey, ids: dict[str, str], times: dict[str, str | None]) -> DataFrame:
    """(row_id, key, created) of the rows whose key is not null; names of the table can't clash with these."""
    t = tables[fk.table]
    when = times.get(fk.table)
    return t.select(
        t[ids[fk.table]].alias("row_id"),
        t[fk.column].alias("key"),
        (t[when] if when else F.lit(None)).cast("timestamp_ntz").alias("created"),
    ).where(F.col("key").isNotNull())


def orphan_cascade(
    tables: dict[str, DataFrame],
    keys: list[ForeignKey],
    *,
    ids: dict[str, str] | None = None,
    times: dict[str, str | None] | None = None,
) -> DataFrame:
    """Orphan references as rows (ref_table, ref_column, row_id, created, kind, reason, depth).

    A reference is a *direct* orphan if its key is not null and either no row of the target has it
    (reason `missing`) or every such row was created later than the referring row (`late`). A
    reference to an existing row that is itself an orphan record, i.e. a row with at least one
    orphan reference, is an *inherited* orphan (reason `orphan parent`, depth one more than that of
    its nearest orphan ancestor). Inherited orphans are found by a fixpoint: each round joins the
    references by a semi join to the records that became orphans in the round before, and rounds
    end when no record is new, so cycles in the foreign keys end too.

    `ids` names the id column of each table (default `id`), `times` its creation time (default
    `created_datetime`; None: has none). Defined cases: a null key refers to nothing and never comes
    out; a row whose own time is null, or a target row whose time is null, is never `late`; target
    ids that repeat count with their earliest time; repeated referring rows each come out; a table
    without rows refers to nothing, and one that is a target orphans every reference to it.

    Scale: the target side is reduced to one row a key before the join; keys that hold a large share
    of the referring rows meet it in a broadcast of bounded size; each round's new orphans are a
    written table, so lineage doesn't grow and a lost executor costs only its own tasks.
    """
    ids = {t: "id" for t in tables} | (ids or {})
    times = {t: "created_datetime" for t in tables} | (times or {})
    spark = next(iter(tables.values())).sparkSession
    stage = Stage(spark)

    def direct(fk: ForeignKey) -> DataFrame:
        refs = _references(tables, fk, ids, times)
        target, when = tables[fk.target], times.get(fk.target)
        present = (
            target.select(target[fk.target_column].alias("key"), (target[when] if when else F.lit(None)).cast("timestamp_ntz").alias("since"))
            .where(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.min("since").alias("since"), F.count(F.lit(1)).alias("present"), F.count("since").alias("timed"))
            .withColumn("since", F.when(F.col("timed") == F.col("present"), F.col("since")))
            .drop("timed")
        )
        reason = F.when(F.col("present").isNull(), "missing").when(F.col("since") > F.col("created"), "late")
        return (
            skew_join(refs, present, ["key"], "left")
            .withColumn("reason", reason)
            .where(F.col("reason").isNotNull())
            .select(F.lit(fk.table).alias("ref_table"), F.lit(fk.column).alias("ref_column"), "row_id", "created", F.lit("direct").alias("kind"), "reason", F.lit(0).alias("depth"))
        )

    found = reduce(DataFrame.unionByName, [direct(fk) for fk in keys])
    if not any(fk.target == other.table for fk in keys for other in keys):
        return found.select(*OUT)  # no orphan can have children: nothing to iterate

    rounds = [stage.save(found)]
    frontier, depth = rounds[0], 0
    while True:
        depth += 1
        bearing = {r[0] for r in frontier.select("ref_table").distinct().collect()}  # names of tables only
        steps = []
        for fk in keys:
            if fk.target not in bearing:
                continue
            target = tables[fk.target]
            # Keys of target rows that became orphans in the last round, by the id of those rows.
            gone = (
                frontier.where(F.col("ref_table") == fk.target)
                .select(F.col("row_id").alias("_id"))
                .distinct()
            )
            gone = (
                gone.select(F.col("_id").alias("key"))
                if fk.target_column == ids[fk.target]
                else target.select(target[ids[fk.target]].alias("_id"), target[fk.target_column].alias("key")).join(gone, "_id", "left_semi").select("key").distinct()
            )
            step = skew_join(_references(tables, fk, ids, times), gone, ["key"], "left_semi").select(
                F.lit(fk.table).alias("ref_table"), F.lit(fk.column).alias("ref_column"), "row_id", "created",
                F.lit("inherited").alias("kind"), F.lit("orphan parent").alias("reason"), F.lit(depth).alias("depth"),
            )
            same = reduce(DataFrame.unionByName, rounds).where((F.col("ref_table") == fk.table) & (F.col("ref_column") == fk.column))
            steps.append(step.join(same.select("row_id").distinct(), "row_id", "left_anti"))
        if not steps:
            break
        new = stage.save(reduce(DataFrame.unionByName, steps).select(*OUT))
        if new.isEmpty():
            stage.drop(new)
            break
        # Only records that were no orphans before pass it on.
        fresh = new.join(reduce(DataFrame.unionByName, rounds).select("ref_table", "row_id").distinct(), ["ref_table", "row_id"], "left_anti")
        rounds.append(new)
        frontier = fresh
    return reduce(DataFrame.unionByName, rounds).select(*OUT)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, column, calendar month of the row, kind and reason."""
    return orphans.groupBy(
        "ref_table", "ref_column", F.date_format("created", "yyyy-MM").alias("month"), "kind", "reason"
    ).agg(F.count(F.lit(1)).alias("n_rows"))
