"""Reports in all their groupings, annotation studies and lookups (section 2.12 of the survey), with SQL counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import stats as ST
from quillgraph.operators import summary as S
from quillgraph.operators.dedup import best_per_key, greedy_pairs, latest, strictly_unique
from quillgraph.operators.reshape import first_by, interactions, melt, mode_smallest, one_hot, ranked_order, renamed, replaced, stack_sources, transpose, without_audit
from quillgraph.operators.scorer import last_wins
from quillgraph.plans import team as T
from quillgraph.plans.bridge import SURE, Graph, with_parts
from quillgraph.runtime import Stage, read
from quillgraph.sources.landed import commit_churn, contributor_totals

QUERIES, SQL = {}, {}
TEAM = ["n_authors", "n_author_devs", "n_author_non_devs", "n_non_author_devs"]
# Name of a grouping and its column; every report by group has these and `overall`.
GROUPS = {"access": "is_open_access", "domain": "domain", "type": "document_type"}


def query(parts: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_parts(parts, sql) if parts else sql
        return f

    return add


def by_groups(df: DataFrame, groups: dict[str, str] = GROUPS) -> DataFrame:
    """Every row once a grouping and once for `overall`, with (grouping, group_value)."""
    each = [F.struct(F.lit(g).alias("grouping"), F.col(c).cast("string").alias("group_value")) for g, c in groups.items()]
    return df.select("*", F.inline(F.array(*each, F.struct(F.lit("overall").alias("grouping"), F.lit("overall").alias("group_value"))))).where("group_value is not null")


def _grouped(source: str, groups: dict[str, str] = GROUPS) -> str:
    """SQL of the same: rows of a common table with (grouping, group_value)."""
    return " UNION ALL ".join(f"SELECT '{g}' AS grouping, CAST({c} AS VARCHAR) AS group_value, * FROM {source}" for g, c in [*groups.items(), ("overall", "'overall'")])


# ---- counts and teams


@query("pairs documents domains authors contributors", f""", x AS (SELECT p.document_id, p.repository_id, p.source, d.document_type, d.is_open_access, m.domain FROM pairs p JOIN documents d USING (document_id) JOIN domains m USING (document_id)),
    g AS ({_grouped('x', GROUPS | {'source': 'source'})})
    SELECT grouping, group_value, count(DISTINCT document_id) AS n_pairs, count(DISTINCT researcher_id) AS n_authors, count(DISTINCT account_id) AS n_devs FROM (
        SELECT grouping, group_value, document_id, researcher_id, NULL AS account_id FROM g JOIN authors USING (document_id) UNION ALL SELECT grouping, group_value, document_id, NULL, account_id FROM g JOIN contributors USING (repository_id)) GROUP BY 1, 2""")
def count_report_people(spark, d):
    """Pairs, authors and developers per group (D-03)."""
    g = Graph(spark, d)
    rows = g.pairs.join(g.documents, "document_id").join(g.domains.select("document_id", "domain"), "document_id")
    return _people(g, by_groups(rows, GROUPS | {"source": "source"}))


def _people(g: Graph, rows: DataFrame) -> DataFrame:
    rows = rows.select("grouping", "group_value", "document_id", "repository_id")
    people = rows.join(g.authors.select("document_id", "researcher_id"), "document_id").drop("repository_id")
    devs = rows.join(g.contributors, "repository_id").drop("repository_id")
    n = {"n_pairs": "document_id", "n_authors": "researcher_id", "n_devs": "account_id"}
    return people.unionByName(devs, allowMissingColumns=True).groupBy("grouping", "group_value").agg(*(F.count_distinct(c).alias(k) for k, c in n.items()))


_BASE = """, code AS (SELECT DISTINCT language FROM languages ORDER BY 1 LIMIT 20),
    b0 AS (SELECT t.* FROM team t JOIN languages l USING (repository_id) JOIN documents d USING (document_id) WHERE d.cited_by_count >= 1 AND l.language IN (SELECT language FROM code)),
    b1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS nd FROM b0) WHERE nd = 1),
    base AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY repository_id) AS nr FROM b1) WHERE nr = 1),
    bf AS (SELECT b.*, d.publication_date, d.cited_by_count, d.is_open_access, d.document_type, m.domain, year(d.publication_date) AS publication_year FROM base b JOIN documents d USING (document_id) JOIN repositories r USING (repository_id) JOIN domains m USING (document_id)
        WHERE n_authors >= 3 AND n_devs >= 1 AND datediff('day', d.publication_date, CAST(r.last_pushed_datetime AS DATE)) <= 90),
    cut AS (SELECT * FROM bf WHERE n_authors <= (SELECT quantile_cont(n_authors, 0.97) FROM bf))"""
_BASE_PARTS = "team documents repositories domains languages"


def base_team(g: Graph) -> DataFrame:
    """Teams of the analysis base: pairs with code and citations, strictly unique once more, filtered and cut (D-06, D-08)."""
    code = g.languages.select("language").distinct().orderBy("language").limit(20)
    coded = g.languages.join(F.broadcast(code), "language", "left_semi").select("repository_id")  # 20 rows
    rows = T.team_composition(g).join(coded, "repository_id").join(g.documents.where("cited_by_count >= 1").select("document_id"), "document_id", "left_semi")
    return S.below_quantile(T.team_frame(g, strictly_unique(rows, "document_id", "repository_id")), "n_authors", 0.97)


@query(_BASE_PARTS, f"{_BASE} SELECT document_id, repository_id, {', '.join(TEAM)}, cited_by_count, domain, publication_year FROM cut")
def base_team_frame(spark, d):
    return base_team(Graph(spark, d)).select("document_id", "repository_id", *TEAM, "cited_by_count", "domain", "publication_year")


@query(_BASE_PARTS, f"""{_BASE} SELECT count(*) AS n_pairs, {', '.join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in TEAM)}, round(avg(CASE WHEN n_non_author_devs > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_with_non_authors,
    round(avg(n_non_author_devs) FILTER (WHERE n_non_author_devs > 0), 6) AS non_authors_of_those, quantile_cont(n_authors, 0.5) AS median_authors FROM cut""")
def base_team_scalars(spark, d):
    """The sentence-level figures of the filtered teams (D-08)."""
    some = F.col("n_non_author_devs") > 0
    each = [f for c in TEAM for f in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std"))]
    return base_team(Graph(spark, d)).agg(
        F.count(F.lit(1)).alias("n_pairs"), *each, F.round(F.avg(some.cast("double")), 6).alias("share_with_non_authors"),
        F.round(F.avg(F.when(some, F.col("n_non_author_devs"))), 6).alias("non_authors_of_those"), F.percentile("n_authors", 0.5).alias("median_authors"),
    )


@query("filtered authors contributors", f""", g AS ({_grouped('filtered')}) SELECT grouping, group_value, count(DISTINCT document_id) AS n_pairs, count(DISTINCT researcher_id) AS n_authors, count(DISTINCT account_id) AS n_devs FROM (
        SELECT grouping, group_value, document_id, researcher_id, NULL AS account_id FROM g JOIN authors USING (document_id) UNION ALL SELECT grouping, group_value, document_id, NULL, account_id FROM g JOIN contributors USING (repository_id)) GROUP BY 1, 2""")
def team_counts_by_group(spark, d):
    """Distinct people over the filtered teams, per group and overall (D-09)."""
    g = Graph(spark, d)
    return _people(g, by_groups(T.team_filtered(g)))


_MELT = "unnest(['" + "', '".join(TEAM) + "']) AS metric, unnest([" + ", ".join(TEAM) + "]) AS value"


@query("filtered", f", g AS ({_grouped('filtered')}) SELECT grouping, group_value, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM (SELECT grouping, group_value, {_MELT} FROM g) GROUP BY 1, 2, 3")
def team_summary_by_group(spark, d):
    """Mean and deviation of the four team metrics per group and overall (D-10)."""
    long = melt(by_groups(T.team_filtered(Graph(spark, d))), ["grouping", "group_value"], TEAM)
    return long.groupBy("grouping", "group_value", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count(F.lit(1)).alias("n"))


_BY = {"year": "publication_year", "size": "n_authors"}


@query("filtered", f""", g AS ({" UNION ALL ".join(f"SELECT '{k}' AS grouping, CAST({c} AS VARCHAR) AS group_value, * FROM filtered" for k, c in _BY.items())}),
    k AS (SELECT grouping, group_value FROM g GROUP BY 1, 2 HAVING count(*) >= 50)
    SELECT grouping, group_value, metric, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 6) AS high
    FROM (SELECT grouping, group_value, {_MELT} FROM g SEMI JOIN k USING (grouping, group_value)) GROUP BY 1, 2, 3""")
def team_by_year_and_size(spark, d):
    """Team metrics with intervals per publication year and per team size, of those with 50 pairs and more (D-11)."""
    rows = T.team_filtered(Graph(spark, d))
    each = [F.struct(F.lit(k).alias("grouping"), F.col(c).cast("string").alias("group_value")) for k, c in _BY.items()]
    long = melt(rows.select(*TEAM, F.inline(F.array(*each))), ["grouping", "group_value"], TEAM)
    out = S.mean_interval(long, ["grouping", "group_value", "metric"], "value").where("n >= 50")
    return out.select("grouping", "group_value", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


# ---- code contribution by position, careers


_CODED = ", x AS (SELECT c.*, d.document_type, d.is_open_access, m.domain FROM coders c JOIN documents d USING (document_id) JOIN domains m USING (document_id)), g AS (" + _grouped("x") + ")"


def _flags(spark, d) -> DataFrame:
    g = Graph(spark, d)
    return by_groups(T.code_flags(g).join(g.documents, "document_id").join(g.domains.select("document_id", "domain"), "document_id"))


def _rates(spark, d, k: str) -> DataFrame:
    c = F.col("is_code_contributor")
    return _flags(spark, d).groupBy("grouping", "group_value", k).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c, 1)).alias("n_coding"), F.round(F.avg(c.cast("int")), 6).alias("rate"))


_RATES = "{c} SELECT grouping, group_value, {k}, count(*) AS n, count(*) FILTER (WHERE is_code_contributor) AS n_coding, round(avg(CAST(is_code_contributor AS INT)), 6) AS rate FROM g GROUP BY 1, 2, 3"


@query("coders documents domains", _RATES.format(c=_CODED, k="position"))
def position_rates_by_group(spark, d):
    """Code-contribution rate by author position, per group and overall, in order of the positions (D-14, SL-02)."""
    return _rates(spark, d, "position").orderBy("grouping", "group_value", ranked_order("position", ["first", "middle", "last"]))


@query("coders documents domains", _RATES.format(c=_CODED, k="is_corresponding"))
def corresponding_rates_by_group(spark, d):
    """The same by corresponding status (D-15)."""
    return _rates(spark, d, "is_corresponding")


@query("coders documents domains", f"""{_CODED}, o AS (SELECT grouping, group_value, position, is_code_contributor AS c, count(*) AS n FROM g GROUP BY 1, 2, 3, 4), r AS (SELECT grouping, group_value, position, sum(n) AS r FROM o GROUP BY 1, 2, 3), k AS (SELECT grouping, group_value, c, sum(n) AS k FROM o GROUP BY 1, 2, 3),
    t AS (SELECT grouping, group_value, sum(n) AS t FROM o GROUP BY 1, 2)
    SELECT grouping, group_value, CAST(max(t) AS BIGINT) AS n, CAST((count(DISTINCT position) - 1) * (count(DISTINCT k.c) - 1) AS INTEGER) AS dof, round(sum(pow(coalesce(o.n, 0) - r.r * k.k / CAST(t AS DOUBLE), 2) / (r.r * k.k / CAST(t AS DOUBLE))), 6) AS chi2
    FROM r JOIN k USING (grouping, group_value) JOIN t USING (grouping, group_value) LEFT JOIN o USING (grouping, group_value, position, c) GROUP BY 1, 2 HAVING count(DISTINCT k.c) = 2 AND count(DISTINCT position) > 2""")
def position_chi2_by_group(spark, d):
    """Chi-squared statistic of position and code contribution per group and overall (D-14), of tables of at least three positions."""
    return _chi2(spark, d).select("grouping", "group_value", "n", "dof", F.round("chi2", 6).alias("chi2"))


def _chi2(spark, d) -> DataFrame:
    stage = Stage(spark)
    o = stage.save(_flags(spark, d).groupBy("grouping", "group_value", "position", F.col("is_code_contributor").alias("c")).agg(F.count(F.lit(1)).alias("n")))  # a few rows a group
    k = ["grouping", "group_value"]
    r, c, t = o.groupBy(*k, "position").agg(F.sum("n").alias("r")), o.groupBy(*k, "c").agg(F.sum("n").alias("k")), o.groupBy(*k).agg(F.sum("n").alias("t"))
    cells = r.join(c, k).join(t, k).join(o, [*k, "position", "c"], "left").na.fill(0, ["n"])
    e = F.col("r") * F.col("k") / F.col("t")
    out = cells.groupBy(*k).agg(F.max("t").alias("n"), F.count_distinct("position").alias("_p"), F.count_distinct("c").alias("_c"), F.sum(F.pow(F.col("n") - e, 2) / e).alias("chi2"))
    return out.where("_c = 2 and _p > 2").withColumn("dof", ((F.col("_p") - 1) * (F.col("_c") - 1)).cast("int"))


@query()
def position_posthoc_by_group(spark, d):
    """Binomial tests of each position against a half, corrected within the group, where chi-squared is significant overall and always in groups (D-14, Z-26)."""
    chi = {(r["grouping"], r["group_value"]): (r["chi2"], ST.chi2_tail(r["chi2"], r["dof"])) for r in _chi2(spark, d).collect()}  # a row a group
    counts: dict = {}
    for r in _rates(spark, d, "position").orderBy("grouping", "group_value", ranked_order("position", ["first", "middle", "last"])).collect():
        counts.setdefault((r["grouping"], r["group_value"]), []).append((r["position"], r["n_coding"], r["n"]))
    rows = []
    for key, found in counts.items():
        x, p = chi.get(key, (None, None))
        gate = key[0] != "overall" or p is not None and p < 0.05
        tests = ST.bonferroni([ST.binomial_test(k, n) for _, k, n in found]) if gate else [None] * len(found)
        rows += [(*key, pos, k, n, x, p, q) for (pos, k, n), q in zip(found, tests)]
    out = spark.createDataFrame(rows, "grouping string, group_value string, position string, n_coding long, n long, chi2 double, p double, posthoc_p double")
    return out.withColumn("stars", X.stars(F.col("posthoc_p")))


_MODAL = {"position": "modal_position", "type": "modal_type", "domain": "modal_domain"}
_CAREERS = ", g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS category, {c} AS value, * FROM careers" for k, c in _MODAL.items()) + ")"


def _careers(spark, d) -> DataFrame:
    each = [F.struct(F.lit(k).alias("category"), F.col(c).alias("value")) for k, c in _MODAL.items()]
    return T.careers(Graph(spark, d)).select("*", F.inline(F.array(*each)))


@query("careers", f"""{_CAREERS}, b AS (SELECT category, value, coding_status, quantile_cont(h_index, 0.25) AS q1, quantile_cont(h_index, 0.5) AS median, quantile_cont(h_index, 0.75) AS q3 FROM g GROUP BY 1, 2, 3)
    SELECT category, value, coding_status, q1, median, q3, CAST(min(h_index) AS DOUBLE) AS low, CAST(max(h_index) AS DOUBLE) AS high FROM g JOIN b USING (category, value, coding_status) WHERE h_index BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def hindex_box_by_category(spark, d):
    """Five numbers of the h-index by coding status and modal position, type and domain (D-17)."""
    return S.box_plot(_careers(spark, d), "h_index", ["category", "value", "coding_status"])


@query("careers", f"{_CAREERS} SELECT category, value, count(*) AS total, count(*) FILTER (WHERE coding_status = 'any') AS n_any, count(*) FILTER (WHERE coding_status = 'majority') AS n_majority, count(*) FILTER (WHERE coding_status = 'always') AS n_always FROM g GROUP BY 1, 2")
def coding_class_counts_by_category(spark, d):
    """Counts per modal category and coding class (D-18, AG-21)."""
    n = lambda s: F.count(F.when(F.col("coding_status") == s, 1)).alias(f"n_{s}")
    return _careers(spark, d).groupBy("category", "value").agg(F.count(F.lit(1)).alias("total"), n("any"), n("majority"), n("always"))


_CLASS = "CASE WHEN n_coded > 0 THEN 'coding' ELSE 'not coding' END"


@query("careers", f"""{_CAREERS} SELECT category, value, {_CLASS} AS class, metric, count(x) AS n, round(avg(x), 6) AS mean, round(avg(x) - 1.959963984540054 * stddev_samp(x) / sqrt(count(x)), 6) AS low, round(avg(x) + 1.959963984540054 * stddev_samp(x) / sqrt(count(x)), 6) AS high
    FROM (SELECT category, value, n_coded, unnest(['h_index', 'i10_index']) AS metric, unnest([h_index, i10_index]) AS x FROM g WHERE category = 'position') GROUP BY 1, 2, 3, 4""")
def hindex_by_class(spark, d):
    """h- and i10-index by code contribution and position, long, with intervals (D-29, AG-16)."""
    rows = _careers(spark, d).where("category = 'position'").withColumn("class", F.when(F.col("n_coded") > 0, "coding").otherwise("not coding"))
    long = rows.select("category", "value", "class", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in ("h_index", "i10_index")))))
    out = S.mean_interval(long, ["category", "value", "class", "metric"], "x")
    return out.select("category", "value", "class", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("careers", """, s AS (SELECT modal_position AS position, count(*) FILTER (WHERE n_coded > 0) AS n, avg(h_index) FILTER (WHERE n_coded > 0) AS x, var_samp(h_index) FILTER (WHERE n_coded > 0) AS v,
        count(*) FILTER (WHERE n_coded = 0) AS m, avg(h_index) FILTER (WHERE n_coded = 0) AS y, var_samp(h_index) FILTER (WHERE n_coded = 0) AS w FROM (SELECT * FROM careers UNION ALL SELECT * REPLACE ('overall' AS modal_position) FROM careers) GROUP BY 1)
    SELECT position, n + m - 2 AS dof, round((x - y) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0 / n + 1.0 / m)), 6) AS t, round(x - y, 6) AS difference FROM s WHERE n > 1 AND m > 1""")
def hindex_ttest_by_position(spark, d):
    """t statistic of the h-index of coding against other researchers, overall and per position (D-29, ST-08)."""
    return _ttests(spark, d).select("position", F.col("dof").cast("long").alias("dof"), F.round("t", 6).alias("t"), F.round("difference", 6).alias("difference"))


@query()
def hindex_ttest_intervals(spark, d):
    """The same with p and the 95 % interval of the difference."""
    return _ttests(spark, d)


def _ttests(spark, d) -> DataFrame:
    rows = T.careers(Graph(spark, d)).select(F.explode(F.array("modal_position", F.lit("overall"))).alias("position"), (F.col("n_coded") > 0).alias("codes"), "h_index")
    groups: dict = {}
    for r in rows.groupBy("position", "codes").agg(F.count("h_index").alias("n"), F.avg("h_index").alias("x"), F.var_samp("h_index").alias("v")).collect():  # two rows a position
        groups.setdefault(r["position"], {})[r["codes"]] = (r["n"], r["x"], r["v"])
    out = []
    for position, both in groups.items():
        if min(both.get(c, (0,))[0] for c in (True, False)) > 1:
            t, p, dof = ST.t_test(both[True], both[False])
            out.append((position, t, p, int(dof), both[True][1] - both[False][1], *ST.t_interval(both[True], both[False])))
    return spark.createDataFrame(out, "position string, t double, p double, dof long, difference double, low double, high double")


# ---- models


def _variants(rows: DataFrame, y: str, base: list[str], focus: list[str], controls: dict[str, list[str]], family: str, levels: dict[str, list[str]]) -> DataFrame:
    """Coefficients of the model without control and with each control and its interactions (D-12, D-19, ST-06)."""
    stage, out = Stage(rows.sparkSession), []
    for name, columns in {"none": [], **controls}.items():
        data, extra = rows, []
        for c in columns:
            data = one_hot(data, c, levels[c])
            extra += [f"{c}_{v}" for v in sorted(levels[c])[1:]]
        data = interactions(data, focus, extra) if extra else data
        xs = [*base, *extra, *(f"{a} × {b}" for a in focus for b in extra)]
        data = stage.save(data.select(F.col(y).cast("double").alias(y), *(F.col(f"`{x}`").cast("double").alias(X.title_text(x)) for x in xs)))
        out += [{"variant": name} | r for r in ST.log_link_glm(data, y, [X.title_text(x) for x in xs], family)]
        stage.drop(data)
    table = rows.sparkSession.createDataFrame(out, "variant string, name string, coef double, exp_coef double, se double, z double, p double, low double, high double")
    return table.withColumn("stars", X.stars(F.col("p")))


def _levels(rows: DataFrame, *columns: str) -> dict[str, list[str]]:
    from quillgraph.operators.reshape import levels_of

    return {c: levels_of(rows, c) for c in columns}


@query()
def glm_citations_variants(spark, d):
    """Negative binomial model of citations: no control, open access, domain, document type (D-12)."""
    rows = S.between_quantiles(T.team_filtered(Graph(spark, d)), "cited_by_count", 0.03, 0.97).withColumn("is_open_access", F.when(F.col("is_open_access"), "open").otherwise("closed"))
    rows = Stage(spark).save(rows.select("cited_by_count", *TEAM, "years_since", "is_open_access", "domain", "document_type"))
    controls = {"access": ["is_open_access"], "domain": ["domain"], "type": ["document_type"]}
    return _variants(rows, "cited_by_count", ["n_authors", "n_author_devs", "n_non_author_devs", "years_since"], ["n_author_devs", "n_non_author_devs"], controls, "negative_binomial", _levels(rows, "is_open_access", "domain", "document_type"))


@query()
def glm_hindex_variants(spark, d):
    """Gaussian model with log link of the h-index by coding status: no control, position, domain, type (D-19)."""
    rows = S.between_quantiles(T.careers(Graph(spark, d)).where("h_index > 0"), "h_index", 0.03, 0.97)
    rows = Stage(spark).save(rows.select("h_index", "works_count", "coding_status", "modal_position", "modal_domain", "modal_type"))
    found = _levels(rows, "coding_status")["coding_status"]
    kept = [s for s in ("any", "majority", "always") if s in found][: max(1, len(found) - 1)]  # a status of its own is no column beside the constant
    rows = rows.select("*", *((F.col("coding_status") == s).cast("double").alias(s) for s in kept))
    controls = {"position": ["modal_position"], "domain": ["modal_domain"], "type": ["modal_type"]}
    return _variants(rows, "h_index", ["works_count", *kept], [], controls, "gaussian", _levels(rows, "modal_position", "modal_domain", "modal_type"))


@query("careers", "SELECT count(*) AS n, CAST(quantile_cont(h_index, 0.03) AS DOUBLE) AS low, CAST(quantile_cont(h_index, 0.97) AS DOUBLE) AS high FROM careers WHERE h_index > 0")
def hindex_quantile_cut(spark, d):
    """Quantiles of the h-index once zeros are dropped (PF-08)."""
    return T.careers(Graph(spark, d)).where("h_index > 0").agg(F.count(F.lit(1)).alias("n"), F.percentile("h_index", 0.03).alias("low"), F.percentile("h_index", 0.97).alias("high"))


@query("frame", """SELECT n, round(slope, 9) AS slope, round(intercept, 4) AS intercept, round(se, 9) AS se, round(slope - 1.959963984540054 * se, 8) AS low, round(slope + 1.959963984540054 * se, 8) AS high FROM (
    SELECT count(*) AS n, regr_slope(n_authors, publication_year) AS slope, regr_intercept(n_authors, publication_year) AS intercept,
        sqrt((regr_syy(n_authors, publication_year) - regr_slope(n_authors, publication_year) * regr_sxy(n_authors, publication_year)) / (count(*) - 2) / regr_sxx(n_authors, publication_year)) AS se FROM frame)""")
def trend_with_interval(spark, d):
    """Linear trend of team size by year with the interval of its slope (ST-12)."""
    out = S.trend(T.team_frame(Graph(spark, d)), "publication_year", "n_authors")
    return out.select("n", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("se", 9).alias("se"), F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


# ---- links, papers of one source


@query("people researchers", f""", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY confidence DESC, link_id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY confidence DESC, link_id) AS r1 FROM people) WHERE r1 = 1) WHERE r2 = 1)
    SELECT 'all' AS kept, count(*) AS n_links, count(DISTINCT name) AS n_names, round(avg(confidence), 6) AS mean_confidence FROM k JOIN researchers USING (researcher_id) UNION ALL SELECT 'sure', count(*), count(DISTINCT name), round(avg(confidence), 6) FROM k JOIN researchers USING (researcher_id) WHERE confidence >= {SURE}""")
def greedy_link_counts(spark, d):
    """One-to-one links with names: all of them against the sure ones (D-21)."""
    g = Graph(spark, d)
    rows = greedy_pairs(g.people, "researcher_id", "account_id", "confidence", "link_id").join(g.researchers.select("researcher_id", "name"), "researcher_id")
    both = stack_sources(("all", rows), ("sure", rows.where(F.col("confidence") >= SURE)), name="kept")
    return both.groupBy("kept").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("name").alias("n_names"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("pairs authors contributors people", f"""SELECT count(*) AS n_removed FROM (SELECT p.document_id, l.link_id FROM pairs p JOIN authors a USING (document_id) JOIN people l USING (researcher_id) WHERE confidence < {SURE}
    UNION SELECT p.document_id, l.link_id FROM pairs p JOIN contributors c USING (repository_id) JOIN people l USING (account_id) WHERE confidence < {SURE})""")
def removed_links(spark, d):
    """How many relations the threshold removes on either side, each counted once (AG-23)."""
    g = Graph(spark, d)
    unsure = g.people.where(F.col("confidence") < SURE)
    sides = [g.pairs.join(t, k).join(unsure, o).select("document_id", "link_id") for t, k, o in ((g.authors, "document_id", "researcher_id"), (g.contributors, "repository_id", "account_id"))]
    return sides[0].union(sides[1]).distinct().agg(F.count(F.lit(1)).alias("n_removed"))


@query("pairs authors contributors people", f"SELECT researcher_id FROM (SELECT researcher_id FROM authors SEMI JOIN pairs USING (document_id)) INTERSECT SELECT researcher_id FROM people WHERE confidence >= {SURE} AND account_id IN (SELECT account_id FROM contributors SEMI JOIN pairs USING (repository_id))")
def authors_who_contribute(spark, d):
    """Researchers who are authors of pairs and surely own an account that contributes to one (SO-03)."""
    g = Graph(spark, d)
    authors = g.authors.join(g.pairs.select("document_id"), "document_id", "left_semi").select("researcher_id")
    owners = g.people.where(F.col("confidence") >= SURE).join(g.contributors.join(g.pairs.select("repository_id"), "repository_id", "left_semi"), "account_id", "left_semi").select("researcher_id")
    return authors.intersect(owners)


_PAPERS = """, c AS (SELECT p.document_id, year(d.publication_date) AS publication_year, m.domain, d.cited_by_count, t.n_authors, t.n_devs FROM pairs p JOIN documents d USING (document_id) JOIN domains m USING (document_id) JOIN team t USING (document_id) WHERE p.source = 'A')"""


@query("pairs documents domains team", f"""{_PAPERS} SELECT document_id, n_authors, n_devs, n_authors + n_devs AS team_size, round((cited_by_count - avg(cited_by_count) OVER w) / nullif(stddev_samp(cited_by_count) OVER w, 0), 6) AS z FROM c WINDOW w AS (PARTITION BY domain, publication_year)""")
def source_papers(spark, d):
    """Papers of one source with contributors, team size and citations by domain and year as z-scores (D-27)."""
    from quillgraph.operators.dedup import z_scores

    rows = z_scores(_papers(spark, d), ["domain", "publication_year"], "cited_by_count")
    return rows.select("document_id", "n_authors", "n_devs", (F.col("n_authors") + F.col("n_devs")).alias("team_size"), F.round("z", 6).alias("z"))


def _papers(spark, d) -> DataFrame:
    g = Graph(spark, d)
    team = T.team_composition(g).where("source = 'A'").select("document_id", "repository_id", "n_authors", "n_devs")
    return team.join(g.documents, "document_id").join(g.domains.select("document_id", "domain"), "document_id").withColumn("publication_year", F.year("publication_date"))


@query("pairs documents domains team", f"{_PAPERS} SELECT domain, count(*) AS n, round(avg(n_authors + n_devs), 6) AS mean, quantile_cont(n_authors + n_devs, 0.5) AS p50, CAST(max(n_authors + n_devs) AS DOUBLE) AS max FROM c GROUP BY 1")
def source_team_sizes(spark, d):
    rows = _papers(spark, d).withColumn("team_size", F.col("n_authors") + F.col("n_devs"))
    return S.describe(rows, "team_size", ["domain"], (0.5,)).select("domain", "n", F.round("mean", 6).alias("mean"), "p50", "max")


@query("coders team", """, k AS (SELECT document_id, count(*) FILTER (WHERE position = 'first') AS n_first, count(*) FILTER (WHERE position = 'middle') AS n_middle, count(*) FILTER (WHERE position = 'last') AS n_last, count(*) AS n_matched FROM coders WHERE is_code_contributor GROUP BY 1),
    x AS (SELECT k.*, t.n_devs FROM k JOIN team t USING (document_id) WHERE t.n_authors > 1 AND t.n_devs > 0 AND n_last <= 1)
    SELECT document_id, n_first, n_middle, n_last, n_matched, n_devs FROM x WHERE n_devs < (SELECT quantile_cont(n_devs, 0.997) FROM x)""")
def devs_by_position_trimmed(spark, d):
    """Developers by author position per paper: papers of one author, without developers or matches, or with several last-author developers are skipped, then the largest are trimmed (D-28)."""
    g = Graph(spark, d)
    counts = S.crosstab(T.code_flags(g).where("is_code_contributor"), "document_id", "position", ["first", "middle", "last"]).where("n_last <= 1")
    rows = counts.join(T.team_composition(g).where("n_authors > 1 and n_devs > 0").select("document_id", "n_devs"), "document_id").withColumn("n_matched", F.col("n_first") + F.col("n_middle") + F.col("n_last"))
    return S.below_quantile(rows, "n_devs", 0.997, strict=True).select("document_id", "n_first", "n_middle", "n_last", "n_matched", "n_devs")


# ---- annotation studies


_SHARES = {"commits": ("n_commits", "total_repo_commits"), "additions": ("n_additions", "total_repo_additions"), "deletions": ("n_deletions", "total_repo_deletions")}
_OWNER = "lower(split_part(repository_url, '/', 4)) = lower(split_part(developer_account_url, '/', 4))"


def owner_filter(df: DataFrame, mode: str) -> DataFrame:
    """Rows by self-ownership, ignoring case: `all`, `none` (without owners) or `only` (PF-19)."""
    part = lambda c: F.lower(F.split_part(c, F.lit("/"), F.lit(4)))
    own = F.coalesce(part("repository_url") == part("developer_account_url"), F.lit(False))
    return {"all": df, "none": df.where(~own), "only": df.where(own)}[mode]


def _shares_of(df: DataFrame) -> DataFrame:
    total = {"abs": (F.col("n_additions") + F.col("n_deletions"), F.col("total_repo_additions") + F.col("total_repo_deletions"))}
    each = {k: (F.col(a), F.col(b)) for k, (a, b) in _SHARES.items()} | total
    return df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), S.share_of(a, b).alias("x")) for k, (a, b) in each.items()))))


_SHARE_ROWS = "SELECT mode, unnest(['commits', 'additions', 'deletions', 'abs']) AS metric, unnest([n_commits / nullif(total_repo_commits, 0)::DOUBLE, n_additions / nullif(total_repo_additions, 0)::DOUBLE, n_deletions / nullif(total_repo_deletions, 0)::DOUBLE, (n_additions + n_deletions) / nullif(total_repo_additions + total_repo_deletions, 0)::DOUBLE]) AS x FROM m"


@query(sql=f"""WITH m AS (SELECT 'all' AS mode, * FROM cc_na_initial_unresolved_set UNION ALL SELECT 'none', * FROM cc_na_initial_unresolved_set WHERE NOT coalesce({_OWNER}, false) UNION ALL SELECT 'only', * FROM cc_na_initial_unresolved_set WHERE coalesce({_OWNER}, false))
    SELECT mode, metric, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM ({_SHARE_ROWS}) GROUP BY 1, 2""")
def contribution_shares(spark, d):
    """Shares of commits, additions, deletions and both, by owner mode (D-23)."""
    rows = read(spark, d, "cc_na_initial_unresolved_set")
    long = stack_sources(*((m, _shares_of(owner_filter(rows, m))) for m in ("all", "none", "only")), name="mode")
    out = S.describe(long, "x", ["mode", "metric"])
    return out.select("mode", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


_TIDY = "left(regexp_replace(lower({c}), '[^a-z]', '', 'g'), 3)"


def _tidy(c: str) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.col(f"`{c}`")), "[^a-z]", ""), 1, 3)


@query(sql=f"""SELECT question, answer, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY question), 6) AS percent FROM (
    SELECT 'bot' AS question, {_TIDY.format(c='is_bot_account')} AS answer FROM cc_na_annotation UNION ALL SELECT 'author', {_TIDY.format(c='is_actually_author')} FROM cc_na_annotation UNION ALL SELECT 'type', {_TIDY.format(c='contrib_type')} FROM cc_na_annotation) WHERE answer <> '' GROUP BY 1, 2""")
def answer_percentages(spark, d):
    """Counts and percentages of the answers to each question (D-24)."""
    rows = read(spark, d, "cc_na_annotation").select(F.inline(F.array(*(F.struct(F.lit(q).alias("question"), _tidy(c).alias("answer")) for q, c in (("bot", "is_bot_account"), ("author", "is_actually_author"), ("type", "contrib_type"))))))
    return S.shares(rows.where("answer <> ''"), ["question", "answer"], ["question"]).withColumn("percent", F.round("percent", 6))


@query(sql=f"""SELECT a, b, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY a), 6) AS percent FROM (SELECT {_TIDY.format(c='is_actually_author')} AS a, {_TIDY.format(c='contrib_type')} AS b FROM cc_na_annotation) WHERE a <> '' AND b <> '' GROUP BY 1, 2""")
def answer_crosstab(spark, d):
    """Authorship against contribution type, in counts and percent of the row (D-24)."""
    rows = read(spark, d, "cc_na_annotation").select(_tidy("is_actually_author").alias("a"), _tidy("contrib_type").alias("b")).where("a <> '' and b <> ''")
    return S.shares(rows, ["a", "b"], ["a"]).withColumn("percent", F.round("percent", 6))


@query(sql=f"""WITH e AS (SELECT CAST(dataset_source_id AS VARCHAR) AS source, a, b FROM (SELECT {_TIDY.format(c='"eva-is_actually_author"')} AS a, {_TIDY.format(c='"nic-is_actually_author"')} AS b, document_id FROM cc_na_initial_unresolved_set)
        JOIN (SELECT DISTINCT document_id, dataset_source_id FROM document_repository_link WHERE document_id IS NOT NULL) USING (document_id)), x AS (SELECT * FROM e UNION ALL SELECT 'overall', {_TIDY.format(c='"eva-is_actually_author"')}, {_TIDY.format(c='"nic-is_actually_author"')} FROM cc_na_initial_unresolved_set)
    SELECT source, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall, n_disagree FROM (
        SELECT source, count(*) FILTER (WHERE a = 'yes' AND b = 'yes') AS tp, count(*) FILTER (WHERE a <> 'yes' AND b = 'yes') AS fp, count(*) FILTER (WHERE a = 'yes' AND b <> 'yes') AS fn, count(*) FILTER (WHERE a <> b) AS n_disagree FROM x GROUP BY 1)""")
def label_prf_by_source(spark, d):
    """Precision and recall of one annotator against the other, overall and per source, with disagreements (D-25, ST-10)."""
    units = read(spark, d, "cc_na_initial_unresolved_set").select("document_id", _tidy("eva-is_actually_author").alias("a"), _tidy("nic-is_actually_author").alias("b"))
    links = read(spark, d, "document_repository_link").where("document_id is not null").select("document_id", F.col("dataset_source_id").cast("string").alias("source")).distinct()
    rows = units.join(links, "document_id").select("source", "a", "b").unionByName(units.select(F.lit("overall").alias("source"), "a", "b"))
    out = ST.precision_recall(rows, "a", "b", "yes", ["source"])
    apart = rows.groupBy("source").agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_disagree"))
    known = lambda c, n: F.when(n > 0, F.round(c, 9)).alias(c)
    return out.join(apart, "source").select("source", "tp", "fp", "fn", known("precision", F.col("tp") + F.col("fp")), known("recall", F.col("tp") + F.col("fn")), "n_disagree")


@query("pairs authors contributors", """, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(document_id AS VARCHAR)), document_id) AS rn FROM pairs WHERE source <> 'A') WHERE rn <= 20),
    c AS (SELECT source, document_id, count(*) AS n FROM s JOIN authors USING (document_id) JOIN contributors USING (repository_id) GROUP BY 1, 2)
    SELECT source, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, quantile_cont(n, 0.5) AS p50 FROM c GROUP BY 1""")
def annotation_set_stats(spark, d):
    """Twenty pairs per other source, the same at every run, all authors against all developers, and rows per pair (D-26)."""
    g = Graph(spark, d)
    some = best_per_key(g.pairs.where("source <> 'A'"), ["source"], [F.md5(F.col("document_id").cast("string")), F.col("document_id")], 20)
    rows = some.join(g.authors.select("document_id", "researcher_id"), "document_id").join(g.contributors, "repository_id").groupBy("source", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n_rows"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.percentile("n", 0.5).alias("p50"))


@query(sql="SELECT source, framework, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS percent FROM (SELECT source, json_extract_string(paper_extra_data, '$.framework') AS framework FROM basic_repository_document_pair WHERE paper_extra_data IS NOT NULL) WHERE framework IS NOT NULL GROUP BY 1, 2")
def label_percentages_by_source(spark, d):
    """Percentages of a label by source (D-30)."""
    rows = read(spark, d, "basic_repository_document_pair").where("paper_extra_data is not null").select("source", F.get_json_object("paper_extra_data", "$.framework").alias("framework")).where("framework is not null")
    return S.shares(rows, ["source", "framework"], ["source"]).withColumn("percent", F.round("percent", 6))


_LABEL_ROWS = " UNION ALL ".join(f"SELECT '{q}; {v}' AS features, count(*) FILTER (WHERE a = '{v}' AND b = '{v}') AS tp, count(*) FILTER (WHERE a <> '{v}' AND b = '{v}') AS fp, count(*) FILTER (WHERE a = '{v}' AND b <> '{v}') AS fn FROM (SELECT {_TIDY.format(c=f'"eva-{q}"')} AS a, {_TIDY.format(c=f'"nic-{q}"')} AS b FROM cc_na_initial_unresolved_set)" for q, vs in (("contrib-type", ("cod", "doc", "oth")), ("is_actually_author", ("yes", "no"))) for v in vs)


@query(sql=f"SELECT array_to_string(string_split(features, '; '), ', ') AS features, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, rank() OVER (ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC) = 1 AS best FROM ({_LABEL_ROWS})")
def model_comparison(spark, d):
    """Scores of several labellings with their features as a list, and the best of them (D-34, F-09, AG-19)."""
    units = read(spark, d, "cc_na_initial_unresolved_set")
    parts = [ST.precision_recall(units.select(_tidy(f"eva-{q}").alias("a"), _tidy(f"nic-{q}").alias("b")), "a", "b", v).withColumn("features", F.lit(f"{q}; {v}")) for q, vs in (("contrib-type", ("cod", "doc", "oth")), ("is_actually_author", ("yes", "no"))) for v in vs]
    rows = Stage(spark).save(reduce(DataFrame.unionByName, parts))  # a row a labelling
    top = rows.agg(F.max("f1").alias("top"))
    return rows.join(F.broadcast(top)).select(X.relisted(F.col("features"), "; ", ", ").alias("features"), F.round("f1", 9).alias("f1"), (F.col("f1") == F.col("top")).alias("best"))


@query(sql="""WITH l AS (SELECT DISTINCT ON (researcher_id, developer_account_id) researcher_id, developer_account_id, coalesce(predictive_model_confidence, 0) >= 0.97 AS positive FROM researcher_developer_account_link ORDER BY researcher_id, developer_account_id, id DESC)
    SELECT count(*) AS n_pairs, count(*) FILTER (WHERE positive) AS n_positive, count(*) FILTER (WHERE NOT positive) AS n_negative, round(avg(positive::INT), 6) AS positive_share, count(DISTINCT researcher_id) AS n_authors, count(DISTINCT developer_account_id) AS n_devs,
        count(DISTINCT developer_account_id) FILTER (WHERE coalesce(a.name, '') <> '') AS n_devs_with_name, count(DISTINCT developer_account_id) FILTER (WHERE coalesce(a.email, '') <> '') AS n_devs_with_email FROM l JOIN developer_account a ON a.id = developer_account_id""")
def training_set_profile(spark, d):
    """Profile of labelled pairs, the last label of a pair counting; details of an account are read from one text per account (D-35, F-10, J-12)."""
    links = last_wins(read(spark, d, "researcher_developer_account_link"), ["researcher_id", "developer_account_id"], "id")
    links = links.select("researcher_id", "developer_account_id", (F.coalesce("predictive_model_confidence", F.lit(0.0)) >= 0.97).alias("positive"))
    details = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.col(c), "[;:\\s]+", " "), F.lit("")), F.lit("None"))
    text = F.concat(F.lit("username: "), details("username"), F.lit(";\nname: "), details("name"), F.lit(";\nemail: "), details("email"), F.lit(";"))
    accounts = read(spark, d, "developer_account").select(F.col("id").alias("developer_account_id"), X.parsed_fields(text).alias("f"))
    rows = links.join(accounts, "developer_account_id")
    dev = lambda c: F.count_distinct(F.when(F.col("f")[c].isNotNull(), F.col("developer_account_id")))
    p = F.col("positive")
    return rows.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(p, 1)).alias("n_positive"), F.count(F.when(~p, 1)).alias("n_negative"), F.round(F.avg(p.cast("int")), 6).alias("positive_share"), F.count_distinct("researcher_id").alias("n_authors"), F.count_distinct("developer_account_id").alias("n_devs"), dev("name").alias("n_devs_with_name"), dev("email").alias("n_devs_with_email"))


# ---- stored records: small forms


@query(sql="""WITH a AS (SELECT DISTINCT document_id FROM document_alternate_doi WHERE doi IS NOT NULL AND lower(doi) NOT IN (SELECT lower(doi) FROM scholarly_document WHERE doi IS NOT NULL)), k AS (SELECT DISTINCT document_id FROM document_repository_link SEMI JOIN scholarly_document ON scholarly_document.id = document_id)
    SELECT (SELECT count(*) FROM k) AS n_documents, (SELECT count(*) FROM k SEMI JOIN a USING (document_id)) AS n_resolved, (SELECT count(*) FROM a) AS n_resolved_anywhere""")
def alt_key_resolution_overall(spark, d):
    """Overall counts of resolved DOIs, of linked documents and of all (D-05, Z-18)."""
    docs = read(spark, d, "scholarly_document")
    alt = read(spark, d, "document_alternate_doi").where("doi is not null").select("document_id", F.lower("doi").alias("doi"))
    moved = alt.join(docs.select(F.lower("doi").alias("doi")), "doi", "left_anti").select("document_id").distinct()
    links = read(spark, d, "document_repository_link").select("document_id").distinct().join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(links, "n_documents").join(n(links.join(moved, "document_id", "left_semi"), "n_resolved")).join(n(moved, "n_resolved_anywhere"))  # one row each


@query(sql="SELECT id, CASE document_type WHEN 'article' THEN 'research article' ELSE document_type END AS \"Document Type\", CAST(cited_by_count AS DOUBLE) AS \"Cited By Count\" FROM scholarly_document")
def titled_columns(spark, d):
    """Columns without audit, values replaced by a map, names as titles but for those that are kept (PF-01, PF-14, PF-15, PF-17)."""
    rows = without_audit(read(spark, d, "scholarly_document")).select("id", "document_type", F.col("cited_by_count").cast("double").alias("cited_by_count"))
    return renamed(replaced(rows, "document_type", {"article": "research article"}), keep=["id"])


@query(sql="SELECT owner, mode FROM (SELECT owner, forks_count AS mode, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, forks_count) AS rn FROM repository GROUP BY 1, 2) WHERE rn = 1")
def smallest_mode(spark, d):
    """Most frequent value per key, the smallest of equals (AG-11)."""
    return mode_smallest(read(spark, d, "repository"), "owner", "forks_count", "mode")


@query(sql="SELECT repository_id, developer_account_id AS first_account FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_datetime, id) AS rn FROM repository_contributor WHERE developer_account_id IS NOT NULL) WHERE rn = 1")
def first_values(spark, d):
    """First value per key in a defined order (AG-10)."""
    rows = read(spark, d, "repository_contributor").where("developer_account_id is not null")
    return first_by(rows, "repository_id", "developer_account_id", ["created_datetime", "id"], "first_account")


@query(sql="SELECT id, 'https://forge.example/' || owner || '/' || name || '/commits?author=' || username AS url FROM repository_contributor c JOIN (SELECT id AS repository_id, owner, name FROM repository) r USING (repository_id) JOIN (SELECT id AS developer_account_id, username FROM developer_account) a USING (developer_account_id)")
def commit_urls(spark, d):
    """Address of an account's commits to a repository (F-20)."""
    repos = read(spark, d, "repository").select(F.col("id").alias("repository_id"), "owner", F.col("name").alias("repository"))
    devs = read(spark, d, "developer_account").select(F.col("id").alias("developer_account_id"), "username")
    rows = read(spark, d, "repository_contributor").select("id", "repository_id", "developer_account_id").join(repos, "repository_id").join(devs, "developer_account_id")
    return rows.select("id", X.commits_url(F.col("owner"), F.col("repository"), F.col("username"), "https://forge.example").alias("url"))


@query(sql="SELECT max(created_datetime) AS created_datetime FROM scholarly_document")
def newest(spark, d):
    """The newest date (W-09)."""
    return latest(read(spark, d, "scholarly_document"), "created_datetime")


@query(sql="SELECT id, fwci, fwci / nullif(cited_by_count, 0) AS ratio FROM scholarly_document WHERE fwci IS NOT NULL AND isfinite(fwci) AND cited_by_count <> 0")
def finite_rows(spark, d):
    """Rows without null, NaN or infinite values, of a ratio that may be all of them (PF-10)."""
    rows = read(spark, d, "scholarly_document").select("id", "fwci", (F.col("fwci") / F.nullif(F.col("cited_by_count"), F.lit(0))).alias("ratio"))
    return S.finite(rows, "fwci", "ratio")


@query(sql="SELECT metric, max(value) FILTER (WHERE t = 'article') AS article, max(value) FILTER (WHERE t = 'preprint') AS preprint FROM (SELECT t, unnest(['n', 'total']) AS metric, unnest([n, total]) AS value FROM (SELECT document_type AS t, CAST(count(*) AS DOUBLE) AS n, CAST(sum(cited_by_count) AS DOUBLE) AS total FROM scholarly_document GROUP BY 1)) GROUP BY 1")
def transposed_summary(spark, d):
    """A summary turned, a row per figure and a column per type (RS-04)."""
    rows = read(spark, d, "scholarly_document").groupBy(F.col("document_type").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("cited_by_count").alias("total"))
    return transpose(rows, "t", ["n", "total"], ["article", "preprint"])


@query(sql="SELECT dataset_source_id, format('{:,}', count(*)) AS n, printf('%.1f%%', 100.0 * count(predictive_model_confidence) / count(*)) AS scored, CASE WHEN count(*) < 100 THEN '***' WHEN count(*) < 1000 THEN '**' WHEN count(*) < 5000 THEN '*' ELSE '' END AS stars FROM document_repository_link GROUP BY 1")
def formatted_counts(spark, d):
    """Figures as text: thousands, percent, stars (F-11, F-12, SNK-07)."""
    rows = read(spark, d, "document_repository_link").groupBy("dataset_source_id").agg(F.count(F.lit(1)).alias("k"), F.count("predictive_model_confidence").alias("c"))
    p = F.when(F.col("k") < 100, 0.0001).when(F.col("k") < 1000, 0.005).when(F.col("k") < 5000, 0.03).otherwise(0.5)
    return rows.select("dataset_source_id", F.format_number("k", 0).alias("n"), X.percent(F.col("c") / F.col("k")).alias("scored"), X.stars(p).alias("stars"))


@query(sql="SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_first(spark, d):
    """The last fifty events, newest first: reversed order and limit are the feature (SL-08)."""
    return read(spark, d, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)


@query(sql="""WITH e AS (SELECT 'o' AS owner, CAST(user_id % 50 AS VARCHAR) AS repo, CAST(user_id AS VARCHAR) AS login, count(*) AS c, CAST(sum(floor(value)) AS BIGINT) AS a FROM events GROUP BY 1, 2, 3, user_id)
    SELECT owner, repo, login, c AS n_commits, a AS n_additions, CAST(sum(c) OVER (PARTITION BY owner, repo) AS BIGINT) AS total_repo_commits, CAST(sum(a) OVER (PARTITION BY owner, repo) AS BIGINT) AS total_repo_additions FROM e""")
def contributor_shares(spark, d):
    """Weekly statistics per contributor, summed for the contributor and the repository (SRC-14)."""
    e = read(spark, d, "events").select(F.lit("o").alias("owner"), (F.col("user_id") % 50).cast("string").alias("repo"), F.col("user_id").cast("string").alias("login"), F.date_trunc("week", "ts").alias("week"), F.floor("value").cast("long").alias("v"))
    weekly = e.groupBy("owner", "repo", "login", "week").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("a"))
    stats = weekly.groupBy("owner", "repo", "login").agg(F.collect_list(F.struct("c", "a", F.lit(0).cast("long").alias("d"))).alias("weeks"))
    return contributor_totals(stats).select("owner", "repo", "login", "n_commits", "n_additions", "total_repo_commits", "total_repo_additions")


@query(sql="""WITH f AS (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS i, CAST(sum(l_linenumber) AS BIGINT) AS r FROM lineitem GROUP BY 1, 2)
    SELECT CAST(l_orderkey AS VARCHAR) AS hash, CAST(sum(i) AS BIGINT) AS positive_lines_changed, CAST(sum(r) AS BIGINT) AS negative_lines_changed, CAST(sum(i + r) AS BIGINT) AS abs_lines_changed, CAST(count(*) AS INTEGER) AS n_files_changed,
        string_agg('p' || l_partkey || ': +' || i || ' -' || r, '; ' ORDER BY l_partkey) AS per_file_lines_changed FROM f GROUP BY l_orderkey""")
def churn_per_commit(spark, d):
    """Changed lines per commit and file (AG-22), an order standing for a commit and its parts for files."""
    f = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("insertions"), F.sum("l_linenumber").cast("long").alias("deletions"))
    entry = F.struct("l_partkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"), F.struct("insertions", "deletions").alias("n"))
    files = F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["file"], e["n"])))
    return commit_churn(f.groupBy(F.col("l_orderkey").cast("string").alias("hash")).agg(files.alias("files"))).drop("files")
