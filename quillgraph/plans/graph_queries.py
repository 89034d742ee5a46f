"""Reports over the graph model (section 2.12 of the survey), with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import summary as S
from quillgraph.operators.dedup import best_per_key, greedy_pairs, z_scores
from quillgraph.operators.reshape import batches, interactions, melt, one_hot, round_robin, stack_sources
from quillgraph.plans import team as T
from quillgraph.plans.bridge import SURE, Graph, with_parts

QUERIES, SQL = {}, {}


def query(parts: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Graph(spark, d))
        if sql:
            SQL[f.__name__] = with_parts(parts, sql) if parts else sql
        return f

    return add


TEAM = ["n_authors", "n_author_devs", "n_author_non_devs", "n_non_author_devs"]


@query("links documents repositories", "SELECT l.document_id, l.repository_id, d.publication_date, r.name FROM links l JOIN documents d USING (document_id) JOIN repositories r USING (repository_id) ORDER BY 1, 2 LIMIT 10")
def link_listing_topn(g):
    rows = g.links.join(g.documents, "document_id").join(g.repositories, "repository_id")
    return rows.select("document_id", "repository_id", "publication_date", "name").orderBy("document_id", "repository_id").limit(10)


_PER = "SELECT '{k}' AS per, count(*) AS n, avg(c) AS mean, stddev_samp(c) AS std, CAST(min(c) AS DOUBLE) AS min, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.95) AS p95, quantile_cont(c, 0.97) AS p97, quantile_cont(c, 0.99) AS p99, CAST(max(c) AS DOUBLE) AS max FROM (SELECT {k}, count(*) AS c FROM links GROUP BY 1)"


@query("links", _PER.format(k="document_id") + " UNION ALL " + _PER.format(k="repository_id"))
def m2m_profile(g):
    parts = [S.describe(g.links.groupBy(k).agg(F.count(F.lit(1)).alias("c")), "c", quantiles=(0.5, 0.95, 0.97, 0.99)).withColumn("per", F.lit(k)) for k in ("document_id", "repository_id")]
    return parts[0].unionByName(parts[1])


@query("pairs", "SELECT document_id, repository_id, source FROM pairs")
def one_to_one(g):
    return g.pairs


@query("pairs authors contributors document_topics languages", """SELECT 'authors' AS kept, count(*) AS n_rows FROM authors SEMI JOIN pairs USING (document_id)
    UNION ALL SELECT 'contributors', count(*) FROM contributors SEMI JOIN pairs USING (repository_id) UNION ALL SELECT 'document_topics', count(*) FROM document_topics SEMI JOIN pairs USING (document_id)
    UNION ALL SELECT 'languages', count(*) FROM languages SEMI JOIN pairs USING (repository_id)""")
def reduced_cascade_counts(g):
    kept = {"authors": (g.authors, "document_id"), "contributors": (g.contributors, "repository_id"), "document_topics": (g.document_topics, "document_id"), "languages": (g.languages, "repository_id")}
    return stack_sources(*((n, t.join(g.pairs.select(k), k, "left_semi").agg(F.count(F.lit(1)).alias("n_rows"))) for n, (t, k) in kept.items()), name="kept").select("kept", "n_rows")


_COUNTS = "SELECT {c} AS group_value, '{g}' AS grouping, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents, count(DISTINCT researcher_id) AS n_authors FROM x GROUP BY 1"


@query("pairs documents domains authors", ", x AS (SELECT p.document_id, p.source, d.document_type, CAST(d.is_open_access AS VARCHAR) AS access, m.domain, a.researcher_id FROM pairs p JOIN documents d USING (document_id) JOIN domains m USING (document_id) JOIN authors a USING (document_id)) "
    + " UNION ALL ".join(_COUNTS.format(c=c, g=g) for g, c in (("source", "source"), ("type", "document_type"), ("access", "access"), ("domain", "domain"), ("total", "'total'"))))
def count_report(g):
    rows = g.pairs.join(g.documents, "document_id").join(g.domains.select("document_id", "domain"), "document_id").join(g.authors.select("document_id", "researcher_id"), "document_id")
    return S.count_report(rows, {"source": "source", "type": "document_type", "access": "is_open_access", "domain": "domain"}, {"n_documents": "document_id", "n_authors": "researcher_id"})


@query("pairs documents", "SELECT document_id, CASE WHEN source = 'A' THEN 'research article' WHEN source = 'N' THEN 'software article' WHEN document_type = 'preprint' THEN 'preprint' ELSE 'research article' END AS reduced_type FROM pairs JOIN documents USING (document_id)")
def doc_type_reduction(g):
    kind = F.when(F.col("source") == "A", "research article").when(F.col("source") == "N", "software article").when(F.col("document_type") == "preprint", "preprint").otherwise("research article")
    return g.pairs.join(g.documents, "document_id").select("document_id", kind.alias("reduced_type"))


@query("domains", "SELECT * FROM domains")
def top_topic(g):
    return g.domains


@query("pairs documents domains languages", """, code AS (SELECT DISTINCT language FROM languages ORDER BY 1 LIMIT 20)
    SELECT p.document_id, p.repository_id, p.source, d.cited_by_count, d.is_open_access, d.document_type, m.domain FROM pairs p JOIN documents d USING (document_id) JOIN domains m USING (document_id)
    JOIN languages l USING (repository_id) WHERE d.cited_by_count >= 1 AND l.language IN (SELECT language FROM code)""")
def base_frame(g):
    code = g.languages.select("language").distinct().orderBy("language").limit(20)
    coded = g.languages.join(F.broadcast(code), "language", "left_semi")  # 20 rows
    rows = g.pairs.join(coded.select("repository_id"), "repository_id", "left_semi").join(g.documents.where("cited_by_count >= 1"), "document_id")
    return rows.join(g.domains.select("document_id", "domain"), "document_id").select("document_id", "repository_id", "source", "cited_by_count", "is_open_access", "document_type", "domain")


@query("team", "SELECT * FROM team")
def team_composition(g):
    return T.team_composition(g)


@query("filtered", "SELECT document_id, n_authors, n_devs, push_days, duration_days, publication_year, round(years_since, 6) AS years_since FROM filtered")
def team_filtered(g):
    return T.team_filtered(g).select("document_id", "n_authors", "n_devs", "push_days", "duration_days", "publication_year", F.round("years_since", 6).alias("years_since"))


@query("filtered authors contributors", """SELECT document_type, count(DISTINCT document_id) AS n_pairs, count(DISTINCT researcher_id) AS n_authors, count(DISTINCT account_id) AS n_devs FROM (
    SELECT document_type, document_id, researcher_id, NULL AS account_id FROM filtered JOIN authors USING (document_id) UNION ALL SELECT document_type, document_id, NULL, account_id FROM filtered JOIN contributors USING (repository_id)) GROUP BY 1""")
def team_counts_exploded(g):
    rows = T.team_filtered(g).select("document_id", "repository_id", "document_type")
    people = rows.join(g.authors, "document_id").select("document_type", "document_id", "researcher_id")
    devs = rows.join(g.contributors, "repository_id").select("document_type", "document_id", "account_id")
    return people.unionByName(devs, allowMissingColumns=True).groupBy("document_type").agg(F.count_distinct("document_id").alias("n_pairs"), F.count_distinct("researcher_id").alias("n_authors"), F.count_distinct("account_id").alias("n_devs"))


@query("filtered", "SELECT document_type, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (SELECT document_type, unnest(['" + "', '".join(TEAM) + "']) AS metric, unnest([" + ", ".join(TEAM) + "]) AS value FROM filtered) GROUP BY 1, 2")
def team_summary(g):
    return melt(T.team_filtered(g), ["document_type"], TEAM).groupBy("document_type", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("filtered", "SELECT publication_year, metric, round(avg(value), 6) AS mean FROM (SELECT publication_year, unnest(['" + "', '".join(TEAM) + "']) AS metric, unnest([" + ", ".join(TEAM) + "]) AS value FROM filtered WHERE publication_year IN (SELECT publication_year FROM filtered GROUP BY 1 HAVING count(*) >= 20)) GROUP BY 1, 2")
def team_by_year_size(g):
    return melt(S.keys_with_rows(T.team_filtered(g), "publication_year", 20), ["publication_year"], TEAM).groupBy("publication_year", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("coders", "SELECT document_id, researcher_id, is_code_contributor FROM coders")
def author_code_flag(g):
    return T.code_flags(g).select("document_id", "researcher_id", "is_code_contributor")


_RATE = "SELECT {k}, count(*) AS n, count(*) FILTER (WHERE is_code_contributor) AS n_coding, round(avg(CAST(is_code_contributor AS INT)), 6) AS rate FROM coders GROUP BY 1"


def _rate(g, k):
    c = F.col("is_code_contributor")
    return T.code_flags(g).groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c, 1)).alias("n_coding"), F.round(F.avg(c.cast("int")), 6).alias("rate"))


@query("coders", _RATE.format(k="position"))
def position_rates(g):
    return _rate(g, "position")


@query("coders", _RATE.format(k="is_corresponding"))
def corresponding_rates(g):
    return _rate(g, "is_corresponding")


@query("coders", "SELECT position, count(*) FILTER (WHERE is_code_contributor) AS n_true, count(*) FILTER (WHERE NOT is_code_contributor) AS n_false FROM coders GROUP BY 1")
def position_crosstab(g):
    return S.crosstab(T.code_flags(g).withColumn("c", F.col("is_code_contributor").cast("string")), "position", "c", ["true", "false"])


@query("careers", "SELECT researcher_id, n_documents, n_coded, modal_position, modal_type, modal_domain, coding_status, h_index FROM careers")
def researcher_profile(g):
    return T.careers(g).select("researcher_id", "n_documents", "n_coded", "modal_position", "modal_type", "modal_domain", "coding_status", "h_index")


@query("careers", "SELECT modal_position, count(*) AS total, count(*) FILTER (WHERE coding_status = 'any') AS n_any, count(*) FILTER (WHERE coding_status = 'majority') AS n_majority, count(*) FILTER (WHERE coding_status = 'always') AS n_always FROM careers GROUP BY 1")
def coding_class_counts(g):
    n = lambda s: F.count(F.when(F.col("coding_status") == s, 1)).alias(f"n_{s}")
    return T.careers(g).groupBy("modal_position").agg(F.count(F.lit(1)).alias("total"), n("any"), n("majority"), n("always"))


@query("careers", """, b AS (SELECT coding_status, quantile_cont(h_index, 0.25) AS q1, quantile_cont(h_index, 0.5) AS median, quantile_cont(h_index, 0.75) AS q3 FROM careers GROUP BY 1)
    SELECT coding_status, q1, median, q3, CAST(min(h_index) AS DOUBLE) AS low, CAST(max(h_index) AS DOUBLE) AS high FROM careers JOIN b USING (coding_status) WHERE h_index BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4""")
def hindex_box(g):
    return S.box_plot(T.careers(g), "h_index", ["coding_status"])


@query("pairs repositories documents", """SELECT document_type, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, CAST(min(x) AS DOUBLE) AS min, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, CAST(max(x) AS DOUBLE) AS max
    FROM (SELECT document_type, CAST(floor((epoch_us(last_pushed_datetime) - epoch_us(creation_datetime)) / 86400000000.0) AS BIGINT) AS x FROM pairs JOIN repositories USING (repository_id) JOIN documents USING (document_id)) GROUP BY 1""")
def duration_describe(g):
    rows = g.pairs.join(g.repositories, "repository_id").join(g.documents, "document_id").withColumn("x", T.days_between(F.col("creation_datetime"), F.col("last_pushed_datetime")))
    return S.describe(rows, "x", ["document_type"], (0.1, 0.5, 0.9)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("people", "SELECT link_id, researcher_id, account_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY confidence DESC, link_id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY confidence DESC, link_id) AS r1 FROM people) WHERE r1 = 1) WHERE r2 = 1")
def greedy_links(g):
    return greedy_pairs(g.people, "researcher_id", "account_id", "confidence", "link_id")


@query("people", "SELECT confidence, round(sum(n) OVER (ORDER BY confidence) / sum(n) OVER (), 9) AS share FROM (SELECT confidence, count(*) AS n FROM people GROUP BY 1)")
def confidence_ecdf(g):
    return S.ecdf(g.people, "confidence").withColumn("share", F.round("share", 9))


@query("pairs authors contributors people", """SELECT document_id, repository_id, account_id, nl AS n_researchers FROM (
    SELECT p.document_id, p.repository_id, c.account_id, count(DISTINCT b.researcher_id) AS nl, count(a.researcher_id) AS na FROM pairs p JOIN contributors c USING (repository_id)
    LEFT JOIN (SELECT * FROM (SELECT p.repository_id, c.account_id, l.researcher_id, l.confidence, row_number() OVER (PARTITION BY p.repository_id, l.researcher_id ORDER BY l.confidence DESC, l.link_id) AS rn
        FROM pairs p JOIN contributors c USING (repository_id) JOIN people l USING (account_id)) WHERE rn = 1 AND confidence >= 97) b ON b.repository_id = p.repository_id AND b.account_id = c.account_id
    LEFT JOIN authors a ON a.document_id = p.document_id AND a.researcher_id = b.researcher_id GROUP BY 1, 2, 3) WHERE nl <= 3 AND na = 0""")
def non_author_devs(g):
    return T.non_author_developers(g.pairs, g.authors, g.contributors, g.people).select("document_id", "repository_id", "account_id", "n_researchers")


@query("pairs authors contributors", "SELECT document_id, repository_id, researcher_id, account_id FROM pairs JOIN authors USING (document_id) JOIN contributors USING (repository_id)")
def candidate_pairs(g):
    return g.pairs.join(g.authors, "document_id").join(g.contributors, "repository_id").select("document_id", "repository_id", "researcher_id", "account_id")


_FRAME = "documents domains"
_Z = "SELECT document_id, domain, year(publication_date) AS publication_year, cited_by_count FROM documents JOIN domains USING (document_id)"


def _cited(g):
    return g.documents.join(g.domains.select("document_id", "domain"), "document_id").select("document_id", "domain", F.year("publication_date").alias("publication_year"), "cited_by_count")


@query(_FRAME, f"SELECT document_id, round((cited_by_count - avg(cited_by_count) OVER w) / nullif(stddev_samp(cited_by_count) OVER w, 0), 6) AS z FROM ({_Z}) WINDOW w AS (PARTITION BY domain, publication_year)")
def zscore_by_group(g):
    return z_scores(_cited(g), ["domain", "publication_year"], "cited_by_count").select("document_id", F.round("z", 6).alias("z"))


@query(_FRAME, f"SELECT domain, publication_year, round(avg(cited_by_count), 6) AS mean_cited FROM ({_Z}) WHERE publication_year >= 1993 AND publication_year < 1998 GROUP BY 1, 2")
def yearly_means(g):
    return _cited(g).where("publication_year >= 1993 and publication_year < 1998").groupBy("domain", "publication_year").agg(F.round(F.avg("cited_by_count"), 6).alias("mean_cited"))


@query("coders", "SELECT document_id, count(*) FILTER (WHERE position = 'first') AS n_first, count(*) FILTER (WHERE position = 'middle') AS n_middle, count(*) FILTER (WHERE position = 'last') AS n_last FROM coders WHERE is_code_contributor GROUP BY 1 HAVING count(*) FILTER (WHERE position = 'last') <= 1")
def devs_by_position(g):
    return S.crosstab(T.code_flags(g).where("is_code_contributor"), "document_id", "position", ["first", "middle", "last"]).where("n_last <= 1")


@query("coders repositories domains", "SELECT c.document_id, c.repository_id, r.name, m.topic, count(*) FILTER (WHERE position = 'first') AS n_first, count(*) FILTER (WHERE position = 'last') AS n_last FROM coders c JOIN repositories r USING (repository_id) JOIN domains m USING (document_id) WHERE is_code_contributor GROUP BY 1, 2, 3, 4")
def matched_by_position(g):
    counts = S.crosstab(T.code_flags(g).where("is_code_contributor"), "document_id", "position", ["first", "last"])
    return counts.join(g.pairs, "document_id").join(g.repositories, "repository_id").join(g.domains, "document_id").select("document_id", "repository_id", "name", "topic", "n_first", "n_last")


@query("frame", "SELECT round(corr(duration_days, n_author_devs / CAST(n_devs AS DOUBLE)), 6) AS r, round(regr_slope(n_authors, publication_year), 6) AS slope, round(regr_intercept(n_authors, publication_year), 4) AS intercept FROM frame")
def pearson_and_trend(g):
    rows = T.team_frame(g)
    share = S.share_of(F.col("n_author_devs"), F.col("n_devs"))
    return rows.agg(F.round(F.corr("duration_days", share), 6).alias("r"), F.round(F.regr_slope("n_authors", "publication_year"), 6).alias("slope"), F.round(F.regr_intercept("n_authors", "publication_year"), 4).alias("intercept"))


@query("filtered", """SELECT document_id, CAST(document_type = 'preprint' AS INT)::DOUBLE AS document_type_preprint, n_authors * CAST(document_type = 'preprint' AS INT)::DOUBLE AS "n_authors × document_type_preprint" FROM filtered""")
def one_hot_interactions(g):
    rows = one_hot(T.team_filtered(g), "document_type", ["article", "preprint"])
    return interactions(rows, ["n_authors"], ["document_type_preprint"]).select("document_id", "document_type_preprint", "n_authors × document_type_preprint")


@query("filtered", "SELECT document_id FROM filtered WHERE cited_by_count BETWEEN (SELECT quantile_cont(cited_by_count, 0.03) FROM filtered) AND (SELECT quantile_cont(cited_by_count, 0.97) FROM filtered)")
def between_quantiles(g):
    return S.between_quantiles(T.team_filtered(g), "cited_by_count", 0.03, 0.97).select("document_id")


@query("links", "SELECT document_id, repository_id, CAST(rn // 50 AS BIGINT) AS batch, rn % 7 AS slot FROM (SELECT *, row_number() OVER (ORDER BY document_id, repository_id) - 1 AS rn FROM links)")
def batch_index_round_robin(g):
    rows = round_robin(batches(g.links.select("document_id", "repository_id"), ["document_id", "repository_id"]), ["document_id", "repository_id"], 7)
    return rows.select("document_id", "repository_id", F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"))


@query("contributors", "SELECT repository_id, account_id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY account_id) AS rn FROM contributors) WHERE rn <= 30")
def top_contributors(g):
    return best_per_key(g.contributors, ["repository_id"], [F.col("account_id")], 30)


@query("people", f"SELECT account_id, count(*) AS n_links, count(*) FILTER (WHERE confidence >= {SURE}) AS n_sure, max_by(researcher_id, confidence * 1000000 - researcher_id) AS best_researcher FROM people GROUP BY 1")
def account_link_profile(g):
    return g.people.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_links"), F.count(F.when(F.col("confidence") >= SURE, 1)).alias("n_sure"), F.max_by("researcher_id", F.col("confidence") * 1_000_000 - F.col("researcher_id")).alias("best_researcher"))
