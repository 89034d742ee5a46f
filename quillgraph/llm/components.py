"""Consolidating pairwise matches into groups (problem 5): connected components by seed-tree pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import skew_join
from quillgraph.runtime import Stage

#: Accounts are numbered above all researchers, so the least vertex of a group is a researcher.
OFFSET = 1 << 62


def components(edges: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(node, root) of every end of `edges` (u bigint, v bigint); root is the least node of its group.

    Each round, every vertex u tells its neighbours and itself the least vertex of its neighbourhood;
    a vertex that nobody chose as a minimum drops out into the propagation forest, with the least
    vertex it was told as its parent, and the vertices told to one vertex stay joined through the
    least of them. A vertex left without a neighbour is a seed. Then the seeds' identifiers flow down
    the forest, from the last round to the first; a vertex that dropped out in one round has a parent
    that stayed longer, so one join a round is enough.

    Defined cases: edges with a null end are ignored; u = v makes the node known without joining
    anything; repeated and reversed edges change nothing; no edges give no rows; further columns are
    ignored.

    Scale: minima are combined before each shuffle, hubs meet their minimum in a bounded broadcast
    (`skew_join`), each step is a written table that is counted while it is written, and only these
    counts reach the driver. Every vertex has a loop, by which seeds are told from what a round reads.
    """
    stage = stage or Stage(edges.sparkSession)

    def ends(rows: DataFrame, *more) -> DataFrame:
        u, v = F.col("u"), F.col("v")
        return rows.select(F.inline(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in ((u, v), (v, u), *more)))))

    u, v = F.col("u"), F.col("v")
    start = edges.select(u.cast("long").alias("u"), v.cast("long").alias("v")).na.drop()
    links = F.sum((u != v).cast("long"))
    graph, n, m = stage.save_counted(ends(start, (u, u), (v, v)).distinct(), links)
    forest: list[tuple[DataFrame, int]] = []
    seeds: list[DataFrame] = []
    while m:
        least = graph.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        alone = (F.col("least") == u) & (F.col("most") == u)
        seeds.append(least.where(alone).select("u"))
        told, n_told = stage.save_counted(skew_join(graph, least.where(~alone).select("u", "least"), ["u"], total=n).select(v.alias("u"), "least"))
        # The loop of a vertex tells it its own minimum.
        chosen, n_chosen = stage.save_counted(told.groupBy("u").agg(F.min("least").alias("parent"), F.max("least").alias("most"), F.max((F.col("least") == u).cast("int")).alias("stays")))
        forest.append((chosen.where("stays = 0").select("u", "parent"), n_chosen))
        joined = skew_join(told, chosen.where("parent < most").select("u", "parent"), ["u"], total=n_told).where("least <> parent").select(F.col("least").alias("u"), F.col("parent").alias("v"))
        graph, n, m = stage.save_counted(ends(joined).union(chosen.where("stays = 1").select("u", u.alias("v"))).distinct(), links)
        stage.drop(told)
    parts = [stage.save(reduce(DataFrame.union, [*seeds, graph.select("u")]).select(u.alias("node"), u.alias("root")))]  # of the last graph, only loops are left
    for k, (tree, size) in enumerate(reversed(forest)):
        known = reduce(DataFrame.union, parts).select(F.col("node").alias("parent"), "root")
        below = skew_join(tree, known, ["parent"], total=size).select(u.alias("node"), "root")
        parts.append(stage.save(below) if k + 1 < len(forest) else below)
    return reduce(DataFrame.union, parts)


def match_groups(
    links: DataFrame,
    left: str = "researcher_id",
    right: str = "developer_account_id",
    confidence: str = "predictive_model_confidence",
    *,
    kinds: tuple[str, str] = ("researcher", "account"),
    least_confidence: float = 0.97,
) -> DataFrame:
    """(group_id, record_kind, record_id) of every end of a link of at least `least_confidence`.

    `group_id` is the least `left` id that is joined to the record directly or through others.
    Defined cases: a null or NaN confidence counts as lower; a link with a null end joins nothing;
    re-scored pairs count if any of their rows is confident enough; ids of the two sides never clash.
    Ids must lie within ±2^61, else the query fails rather than mixing records up.
    """
    sure = links.where(F.col(confidence).isNotNull() & ~F.isnan(F.col(confidence).cast("double")) & (F.col(confidence) >= least_confidence))

    def known(c: str):
        return F.when(F.col(c).between(-(1 << 61), 1 << 61), F.col(c)).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} is out of range")).cast("long"))

    edges = sure.select(known(left).alias("u"), (known(right) + F.lit(OFFSET)).alias("v"))
    is_right = F.col("node") >= F.lit(OFFSET - (1 << 61))
    return components(edges).select(
        F.col("root").alias("group_id"),
        F.when(is_right, kinds[1]).otherwise(kinds[0]).alias("record_kind"),
        F.when(is_right, F.col("node") - F.lit(OFFSET)).otherwise(F.col("node")).alias("record_id"),
    )
