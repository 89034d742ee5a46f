"""Queries over the stored records, the landed pairs, labels, texts and events, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import codehost as C
from quillgraph.functions import text as X
from quillgraph.operators import stats as ST
from quillgraph.operators import summary as S
from quillgraph.operators.dedup import best_per_key, greedy_pairs, strictly_unique
from quillgraph.operators.reshape import hash_sample, sample_per_group, stack_sources
from quillgraph.operators.scorer import match_pairs
from quillgraph.operators.store import get_or_create, not_yet_stored
from quillgraph.plans import team as T
from quillgraph.plans.bridge import Graph
from quillgraph.runtime import Stage, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- stored records


@query("SELECT s.dataset_source_id, s.n AS n_links, s.docs AS n_documents, s.repos AS n_repositories FROM (SELECT dataset_source_id, count(*) AS n, count(DISTINCT document_id) AS docs, count(DISTINCT repository_id) AS repos FROM document_repository_link GROUP BY 1) s")
def stored_links_by_source(spark, d):
    return read(spark, d, "document_repository_link").groupBy("dataset_source_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("document_id").alias("n_documents"), F.count_distinct("repository_id").alias("n_repositories"))


@query("""WITH l AS (SELECT document_id, repository_id, min(dataset_source_id) AS dataset_source_id FROM document_repository_link WHERE document_id IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT * FROM l WHERE document_id IN (SELECT document_id FROM l GROUP BY 1 HAVING count(*) = 1))
    SELECT * FROM a WHERE repository_id IN (SELECT repository_id FROM a GROUP BY 1 HAVING count(*) = 1)""")
def stored_one_to_one(spark, d):
    rows = read(spark, d, "document_repository_link").where("document_id is not null").groupBy("document_id", "repository_id").agg(F.min("dataset_source_id").alias("dataset_source_id"))
    return strictly_unique(rows, "document_id", "repository_id")


@query("""WITH a AS (SELECT DISTINCT document_id FROM document_alternate_doi WHERE doi IS NOT NULL AND lower(doi) NOT IN (SELECT lower(doi) FROM scholarly_document WHERE doi IS NOT NULL)),
    l AS (SELECT DISTINCT dataset_source_id, document_id FROM document_repository_link SEMI JOIN scholarly_document ON scholarly_document.id = document_id)
    SELECT dataset_source_id, count(*) AS n_documents, count(a.document_id) AS n_resolved, round(count(a.document_id) / CAST(count(*) AS DOUBLE), 6) AS rate FROM l LEFT JOIN a USING (document_id) GROUP BY 1""")
def alt_key_resolution(spark, d):
    docs = read(spark, d, "scholarly_document")
    alt = read(spark, d, "document_alternate_doi").where("doi is not null").select("document_id", F.lower("doi").alias("doi"))
    moved = alt.join(docs.select(F.lower("doi").alias("doi")), "doi", "left_anti").select("document_id").distinct().withColumn("moved", F.lit(1))
    links = read(spark, d, "document_repository_link").select("dataset_source_id", "document_id").distinct().join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    n, k = F.count(F.lit(1)), F.count("moved")
    return links.join(moved, "document_id", "left").groupBy("dataset_source_id").agg(n.alias("n_documents"), k.alias("n_resolved"), F.round(k / n, 6).alias("rate"))


@query("SELECT round(avg(CASE WHEN fwci IS NULL THEN 1.0 ELSE 0.0 END), 9) AS fwci FROM scholarly_document")
def missing_rate(spark, d):
    return S.missing_rate(read(spark, d, "scholarly_document"), "fwci").select(F.round("fwci", 9).alias("fwci"))


@query("SELECT document_type, open_access_status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY document_type), 6) AS percent FROM scholarly_document GROUP BY 1, 2")
def normalised_counts(spark, d):
    rows = S.shares(read(spark, d, "scholarly_document"), ["document_type", "open_access_status"], ["document_type"])
    return rows.withColumn("percent", F.round("percent", 6))


@query("""SELECT document_type, count(cited_by_count) AS n, round(avg(cited_by_count), 6) AS mean, round(stddev_samp(cited_by_count), 6) AS std, CAST(min(cited_by_count) AS DOUBLE) AS min, quantile_cont(cited_by_count, 0.1) AS p10, quantile_cont(cited_by_count, 0.25) AS p25,
    quantile_cont(cited_by_count, 0.5) AS p50, quantile_cont(cited_by_count, 0.75) AS p75, quantile_cont(cited_by_count, 0.9) AS p90, CAST(max(cited_by_count) AS DOUBLE) AS max FROM scholarly_document GROUP BY 1""")
def citation_describe(spark, d):
    rows = S.describe(read(spark, d, "scholarly_document"), "cited_by_count", ["document_type"], (0.1, 0.25, 0.5, 0.75, 0.9))
    return rows.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT id, doi_url, lookup_id, publication_year FROM (SELECT id, CASE WHEN starts_with(lower(doi), 'https://doi.org/') THEN lower(doi) ELSE 'https://doi.org/' || lower(doi) END AS doi_url, doi AS lookup_id, year(publication_date) AS publication_year FROM scholarly_document)")
def doi_functions(spark, d):
    return read(spark, d, "scholarly_document").select("id", X.doi_url(F.col("doi")).alias("doi_url"), X.lookup_id(F.col("doi")).alias("lookup_id"), F.year("publication_date").alias("publication_year"))


@query("""SELECT link_id AS id, researcher_id, developer_account_id, predictive_model_confidence FROM (SELECT *, row_number() OVER (PARTITION BY developer_account_id ORDER BY predictive_model_confidence DESC, link_id) AS r2 FROM (
    SELECT id AS link_id, *, row_number() OVER (PARTITION BY researcher_id ORDER BY predictive_model_confidence DESC, id) AS r1 FROM researcher_developer_account_link WHERE predictive_model_confidence >= 0.97) WHERE r1 = 1) WHERE r2 = 1""")
def stored_greedy_links(spark, d):
    rows = read(spark, d, "researcher_developer_account_link").where("predictive_model_confidence >= 0.97")
    return greedy_pairs(rows, "researcher_id", "developer_account_id", "predictive_model_confidence", "id").select("id", "researcher_id", "developer_account_id", "predictive_model_confidence")


@query("SELECT id, repository_id, developer_account_id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, developer_account_id ORDER BY created_datetime, id) AS rn FROM repository_contributor WHERE developer_account_id IS NOT NULL) WHERE rn = 1")
def first_contributor_rows(spark, d):
    rows = read(spark, d, "repository_contributor").where("developer_account_id is not null")
    return best_per_key(rows, ["repository_id", "developer_account_id"], [F.col("created_datetime"), F.col("id")]).select("id", "repository_id", "developer_account_id")


@query("SELECT id, CAST(floor((epoch_us(last_pushed_datetime) - epoch_us(creation_datetime)) / 86400000000.0) AS BIGINT) AS days, round(floor((epoch_us(last_pushed_datetime) - epoch_us(creation_datetime)) / 86400000000.0) / 365.25, 6) AS years FROM repository")
def repository_ages(spark, d):
    days = X.days_between(F.col("creation_datetime"), F.col("last_pushed_datetime"))
    return read(spark, d, "repository").select("id", days.alias("days"), F.round(X.years(days), 6).alias("years"))


# ---- landed pairs


@query("SELECT raw_id, CASE WHEN ends_with(u, '/') THEN u ELSE u || '/' END AS url FROM (SELECT raw_id, replace(replace(replace(lower(regexp_replace(repo_url, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g')), 'https://', ''), 'http://', ''), 'www.', '') AS u FROM basic_repository_document_pair)")
def url_normalise(spark, d):
    return read(spark, d, "basic_repository_document_pair").select("raw_id", C.tidy_url(F.col("repo_url")).alias("url"))


# One address form per remainder of the id, over the whole table.
_FORMS = ["https://github.com/{o}/{n}", "http://www.github.com/{o}/{n}.git", "{o}.github.io/{n}/", "https://{o}.github.com/{n}", "github.com/{o}", "https://{o}.github.io", "https://gitlab.com/{o}/{n}/tree/main", "{o}.gitlab.io/{n}",
          "https://{o}.gitlab.com/{n}/", "gitlab.com/{o}/", "https://bitbucket.org/{o}/{n}/src", "sourceforge.net/projects/{n}/files", "https://forge.example/{o}/{n}", "GITHUB.COM/{o}/{n}/blob/main/x.py"]


def _synthetic(sql: bool):
    if sql:
        cases = " ".join(f"WHEN {i} THEN " + " || ".join(f"'{p}'" if k % 2 == 0 else ("owner" if p == "o" else "name") for k, p in enumerate(_split(f)) if p) for i, f in enumerate(_FORMS))
        return f"CASE CAST(id % {len(_FORMS)} AS INTEGER) {cases} END"
    out = F.lit(None).cast("string")
    for i, f in enumerate(_FORMS):
        parts = [F.lit(p) if k % 2 == 0 else F.col("owner" if p == "o" else "name") for k, p in enumerate(_split(f)) if p]
        out = F.when(F.col("id") % len(_FORMS) == i, F.concat(*parts)).otherwise(out)
    return out


def _split(form: str) -> list[str]:
    return form.replace("{o}", "\0o\0").replace("{n}", "\0n\0").split("\0")


def _host_sql() -> str:
    fits = {h: " OR ".join(f"regexp_matches(u, '{C.pattern(f, 'owner') or C.pattern(f, 'repo')}')" for f in forms) for h, forms in C.FORMS.items()}

    def field(name):
        per = {}
        for h, forms in C.FORMS.items():
            per[h] = "CASE " + " ".join(f"WHEN regexp_matches(u, '{C.pattern(f, 'owner') or C.pattern(f, 'repo')}') THEN " + (f"regexp_extract(u, '{p}', 1)" if (p := C.pattern(f, name)) else "NULL") for f in forms) + " END"
        return "CASE " + " ".join(f"WHEN {fits[h]} THEN {per[h]}" for h in reversed(C.FORMS)) + " END"

    host = "CASE " + " ".join(f"WHEN {fits[h]} THEN '{h}'" for h in reversed(C.FORMS)) + " END"
    url = "replace(replace(replace(lower(trim(url)), 'https://', ''), 'http://', ''), 'www.', '')"
    return f"""WITH t AS (SELECT id, CASE WHEN ends_with({url}, '/') THEN {url} ELSE {url} || '/' END AS u FROM (SELECT id, {_synthetic(True)} AS url FROM repository)),
        p AS (SELECT id, {host} AS host, {field('owner')} AS owner, regexp_replace(split_part({field('repo')}, '/', 1), '\\.git$', '') AS name FROM t)
        SELECT id, CASE WHEN ok THEN host END AS host, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name, CASE WHEN NOT ok THEN 'Could not parse code host URL' END AS error
        FROM (SELECT *, coalesce(CASE WHEN host IS NULL THEN false WHEN host = 'sourceforge' THEN name IS NOT NULL ELSE owner IS NOT NULL END, false) AS ok FROM p)"""


@query(_host_sql())
def codehost_parse(spark, d):
    return read(spark, d, "repository").select("id", C.parse_code_host(_synthetic(False)).alias("p")).select("id", "p.*")


@query("SELECT source, count(*) FILTER (WHERE r % 14 IN (0, 1, 2, 3, 13)) AS n_pairs, count(*) FILTER (WHERE r % 14 NOT IN (0, 1, 2, 3, 13)) AS n_errors FROM (SELECT id AS r, CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 'joss' WHEN 1 THEN 'plos' WHEN 2 THEN 'pwc' ELSE 'softwarex' END AS source FROM repository) GROUP BY 1")
def ingest_split(spark, d):
    src = F.when(F.col("id") % 4 == 0, "joss").when(F.col("id") % 4 == 1, "plos").when(F.col("id") % 4 == 2, "pwc").otherwise("softwarex")
    ok, bad = C.split_pairs(read(spark, d, "repository").select(src.alias("source"), _synthetic(False).alias("repo_url"), F.col("id").cast("string").alias("paper_doi")))
    both = stack_sources(("ok", ok.select("source")), ("bad", bad.select("source")), name="side")
    return both.groupBy("source").agg(F.count(F.when(F.col("side") == "ok", 1)).alias("n_pairs"), F.count(F.when(F.col("side") == "bad", 1)).alias("n_errors"))


@query("""WITH p AS (SELECT raw_id, lower(paper_doi) AS doi, lower(regexp_extract(repo_url, '(?i)forge\\.example/([^/]+)/([^/]+)$', 1)) AS owner, lower(regexp_extract(repo_url, '(?i)forge\\.example/([^/]+)/([^/]+)$', 2)) AS name FROM basic_repository_document_pair),
    d AS (SELECT lower(doi) AS doi, id FROM scholarly_document UNION SELECT lower(doi), document_id FROM document_alternate_doi)
    SELECT raw_id FROM p WHERE doi IS NOT NULL AND owner <> '' AND NOT EXISTS (SELECT 1 FROM d JOIN document_repository_link l ON l.document_id = d.id JOIN repository r ON r.id = l.repository_id WHERE d.doi = p.doi AND lower(r.owner) = p.owner AND lower(r.name) = p.name)""")
def not_yet_stored_pairs(spark, d):
    form = "(?i)forge\\.example/([^/]+)/([^/]+)$"
    pairs = read(spark, d, "basic_repository_document_pair").select("raw_id", "paper_doi", F.regexp_extract("repo_url", form, 1).alias("owner"), F.regexp_extract("repo_url", form, 2).alias("name")).where("paper_doi is not null and owner <> ''")
    return not_yet_stored(pairs, read(spark, d, "scholarly_document"), read(spark, d, "document_alternate_doi"), read(spark, d, "repository"), read(spark, d, "document_repository_link")).select("raw_id")


@query("SELECT framework, count(*) AS n, count(*) FILTER (WHERE official) AS n_official FROM (SELECT json_extract_string(paper_extra_data, '$.framework') AS framework, CAST(json_extract_string(paper_extra_data, '$.is_official') AS BOOLEAN) AS official FROM basic_repository_document_pair WHERE paper_extra_data IS NOT NULL) GROUP BY 1")
def json_field(spark, d):
    j = F.from_json("paper_extra_data", "framework string, is_official boolean")
    rows = read(spark, d, "basic_repository_document_pair").where("paper_extra_data is not null").select(j.alias("j")).select("j.*")
    return rows.groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_official"), 1)).alias("n_official"))


@query("SELECT origin, source, count(*) AS n FROM (SELECT 'pairs' AS origin, source FROM basic_repository_document_pair UNION ALL SELECT 'texts', source FROM documents) GROUP BY 1, 2")
def union_sources(spark, d):
    rows = stack_sources(("pairs", read(spark, d, "basic_repository_document_pair").select("source")), ("texts", read(spark, d, "documents").select("source")), name="origin")
    return rows.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("n"))


# ---- labels


def _tidy(c):
    return F.regexp_replace(F.lower(F.col(f"`{c}`")), "[^a-z]", "")


_E, _N = "regexp_replace(lower(\"eva-contrib-type\"), '[^a-z]', '', 'g')", "regexp_replace(lower(\"nic-contrib-type\"), '[^a-z]', '', 'g')"
_LABELS = f"SELECT left({_E}, 3) AS a, left({_N}, 3) AS b, n_commits, total_repo_commits, n_additions, total_repo_additions FROM cc_na_initial_unresolved_set"


def _labels(spark, d):
    return read(spark, d, "cc_na_initial_unresolved_set").select(F.substring(_tidy("eva-contrib-type"), 1, 3).alias("a"), F.substring(_tidy("nic-contrib-type"), 1, 3).alias("b"), "n_commits", "total_repo_commits", "n_additions", "total_repo_additions")


@query(f"""WITH l AS (SELECT a, b FROM ({_LABELS}) WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM l),
    c AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, count(*) AS n FROM l GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM l GROUP BY 1) y ON a = b)
    SELECT n, round(same / n, 9) AS observed, round(c / (n * n), 9) AS expected, round((same / n - c / (n * n)) / (1 - c / (n * n)), 9) AS kappa FROM (SELECT CAST(n AS DOUBLE) AS n, same, c FROM t, c)""")
def label_agreement(spark, d):
    return ST.kappa(_labels(spark, d), "a", "b").select(F.col("n").cast("double").alias("n"), *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


_PRF = "SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy"


@query(f"{_PRF} FROM (SELECT count(*) FILTER (WHERE a = 'cod' AND b = 'cod') AS tp, count(*) FILTER (WHERE a <> 'cod' AND b = 'cod') AS fp, count(*) FILTER (WHERE a = 'cod' AND b <> 'cod') AS fn, count(*) FILTER (WHERE a <> 'cod' AND b <> 'cod') AS tn FROM ({_LABELS}))")
def label_prf(spark, d):
    out = ST.precision_recall(_labels(spark, d), "a", "b", "cod")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")))


@query(f"""SELECT a, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max
    FROM (SELECT a, n_commits / CAST(nullif(total_repo_commits, 0) AS DOUBLE) AS x FROM ({_LABELS})) GROUP BY 1""")
def share_describe(spark, d):
    rows = _labels(spark, d).withColumn("x", S.share_of(F.col("n_commits"), F.col("total_repo_commits")))
    out = S.describe(rows, "x", ["a"])
    return out.select("a", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


@query("SELECT count(*) AS n_units, count(*) FILTER (WHERE split_part(repository_url, '/', 4) = split_part(developer_account_url, '/', 4)) AS n_owners FROM cc_na_initial_unresolved_set")
def self_owned(spark, d):
    owner = F.split_part("repository_url", F.lit("/"), F.lit(4)) == F.split_part("developer_account_url", F.lit("/"), F.lit(4))
    return read(spark, d, "cc_na_initial_unresolved_set").agg(F.count(F.lit(1)).alias("n_units"), F.count(F.when(owner, 1)).alias("n_owners"))


@query("""SELECT annotator, count(*) FILTER (WHERE c LIKE 'cod%') AS n_code, count(*) FILTER (WHERE c LIKE 'doc%') AS n_docs, count(*) FILTER (WHERE c LIKE 'oth%') AS n_other
    FROM (SELECT annotator, regexp_replace(lower(contrib_type), '[^a-z]', '', 'g') AS c FROM cc_na_annotation) GROUP BY 1""")
def annotator_crosstab(spark, d):
    rows = read(spark, d, "cc_na_annotation").select("annotator", F.regexp_extract(_tidy("contrib_type"), "^(cod|doc|oth)", 1).alias("c"))
    return S.crosstab(rows, "annotator", "c", ["cod", "doc", "oth"]).toDF("annotator", "n_code", "n_docs", "n_other")


# ---- texts and events


@query("SELECT doc_id, text AS content FROM documents")
def inverted_index_text(spark, d):
    """Round trip of every text through its inverted index: the index is built by an aggregation, not within one row."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    index = words.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("at")).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", X.text_of_index(F.col("index")).alias("content"))


@query("SELECT doc_id, base AS content FROM (SELECT doc_id, text AS base FROM documents)")
def base64_round_trip(spark, d):
    return read(spark, d, "documents").select("doc_id", X.decoded(F.base64(F.encode("text", "utf-8"))).alias("content"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_series(spark, d):
    return read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# ---- not expressible in SQL


@query()
def glm_citations(spark, d):
    """Negative binomial model of citations by team (D-12)."""
    rows = S.between_quantiles(T.team_filtered(Graph(spark, d)), "cited_by_count", 0.03, 0.97)
    rows = rows.select("cited_by_count", *(F.col(c).cast("double") for c in ("n_authors", "n_author_devs", "n_non_author_devs", "years_since")))
    return spark.createDataFrame(ST.log_link_glm(Stage(spark).save(rows), "cited_by_count", ["n_authors", "n_author_devs", "n_non_author_devs", "years_since"], "negative_binomial"))


@query()
def glm_hindex(spark, d):
    """Gaussian model with log link of the h-index by career (D-19)."""
    rows = T.careers(Graph(spark, d))
    flag = lambda s: (F.col("coding_status") == s).cast("double").alias(s)
    rows = S.between_quantiles(rows.where("h_index > 0"), "h_index", 0.03, 0.97).select("h_index", "works_count", flag("any"), flag("majority"))
    return spark.createDataFrame(ST.log_link_glm(Stage(spark).save(rows), "h_index", ["works_count", "any"], "gaussian"))


@query()
def chi2_posthoc(spark, d):
    """Code contribution by position: chi-squared test and binomial tests of each position (D-14)."""
    rows = {r["position"]: (r["n_true"], r["n_false"]) for r in S.crosstab(T.code_flags(Graph(spark, d)).withColumn("c", F.col("is_code_contributor").cast("string")), "position", "c", ["true", "false"]).collect()}
    order = [p for p in ("first", "middle", "last") if p in rows]
    x, p, dof = ST.chi2_independence([list(rows[k]) for k in order])
    ps = ST.bonferroni([ST.binomial_test(rows[k][0], sum(rows[k])) for k in order])
    return spark.createDataFrame([(k, *rows[k], x, p, dof, q) for k, q in zip(order, ps)], "position string, n_true long, n_false long, chi2 double, p double, dof int, posthoc_p double")


@query()
def ttest_hindex(spark, d):
    """h-index of researchers who contributed code to any document against those who didn't (D-29)."""
    rows = T.careers(Graph(spark, d)).withColumn("codes", F.col("n_coded") > 0)
    by = {r["codes"]: r["n"] for r in rows.groupBy("codes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(by.get(True, 0), by.get(False, 0)) < 2:
        return spark.createDataFrame([], "t double, p double, dof double")
    return spark.createDataFrame([tuple(float(x) for x in ST.group_t_test(rows, "codes", "h_index", True, False))], "t double, p double, dof double")


@query()
def match_links(spark, d):
    """Scored links of the researchers and accounts that stored links bring together (D-41)."""
    links = read(spark, d, "researcher_developer_account_link").select(F.col("id").alias("document_id"), F.col("id").alias("repository_id"), "researcher_id", "developer_account_id")
    authors = links.select("document_id", "researcher_id").join(read(spark, d, "researcher").select(F.col("id").alias("researcher_id"), "name"), "researcher_id")
    devs = links.select("repository_id", "developer_account_id").join(read(spark, d, "developer_account").select(F.col("id").alias("developer_account_id"), "username", F.col("name").alias("account_name")), "developer_account_id")
    return match_pairs(links, authors, devs, least=0.8)


@query("""SELECT 'first' AS run, count(*) AS n_rows, count(*) AS n_ids FROM (SELECT DISTINCT code_host_id, trim(owner), trim(name) FROM repository) UNION ALL SELECT 'again', 0, 0""")
def store_idempotent(spark, d):
    """Rows and different ids a first run adds to an empty store, and a second run to what the first one stored (D-40)."""
    repos = read(spark, d, "repository")
    rows, keys = repos.drop("id", "created_datetime", "updated_datetime"), ["code_host_id", "owner", "name"]
    first = Stage(spark).save(get_or_create(repos.where("false"), rows, keys))
    again = get_or_create(first, rows, keys)
    both = stack_sources(*((n, t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))) for n, t in (("first", first), ("again", again))), name="run")
    return both.select("run", "n_rows", "n_ids")


@query("""SELECT 'document' AS stored, row_number() OVER (ORDER BY doi) AS id, doi AS natural_key FROM (SELECT DISTINCT trim(doi) AS doi FROM scholarly_document)
    UNION ALL SELECT 'repository', row_number() OVER (ORDER BY code_host_id, owner, name), owner || '/' || name FROM (SELECT DISTINCT code_host_id, trim(owner) AS owner, trim(name) AS name FROM repository)""")
def surrogate_keys(spark, d):
    """Ids that a first run gives to all documents and repositories with all their columns (D-40)."""
    parts = []
    for table, stored, keys, name in (("scholarly_document", "document", ["doi"], F.col("doi")), ("repository", "repository", ["code_host_id", "owner", "name"], F.concat_ws("/", "owner", "name"))):
        rows = read(spark, d, table)
        made = get_or_create(rows.where("false"), rows.drop("id", "created_datetime", "updated_datetime"), keys)
        parts.append(made.select(F.lit(stored).alias("stored"), F.col("id").cast("long").alias("id"), name.alias("natural_key")))
    return parts[0].unionByName(parts[1])


@query()
def annotation_sample(spark, d):
    """Fifty units per source, the same at every run (SL-06), after a repeatable half of the pairs (SL-05)."""
    pairs = hash_sample(read(spark, d, "basic_repository_document_pair"), "raw_id", 0.5)
    return sample_per_group(pairs, "source", "raw_id", 50).select("raw_id", "source", "repo_url", "paper_doi")
