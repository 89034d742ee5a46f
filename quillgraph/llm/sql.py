"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

# Consecutive words of an item that make a leak.
WORDS = 10
_OPEN = "<(\\[{\"''`“”‘’«"
_CLOSE = ".,;:!?)\\]}>\"''`“”’»/"


def _bare(c: str) -> str:
    return f"lower(regexp_replace({c}, '[\\s\\p{{Z}}\\p{{C}}]+', '', 'g'))"


def _doi(c: str) -> str:
    body = f"regexp_extract({_bare(c)}, '^(?:[{_OPEN}]|/|https?:|(?:dx\\.|www\\.)?doi\\.(?:example|org)/|doi[:.]?|:)*(10\\.[0-9]+(?:\\.[0-9]+)*/.*)$', 1)"
    return f"nullif(regexp_replace(regexp_replace({body}, '/+', '/', 'g'), '[{_CLOSE}]+$', ''), '')"


def _repo(c: str) -> str:
    path = f"regexp_replace(regexp_replace({_bare(c)}, '^(?:[{_OPEN}]|/|https?:|git:|www\\.)+', ''), '/+', '/', 'g')"
    path = f"regexp_replace(regexp_replace({path}, '[{_CLOSE}]+$', ''), '\\.git$', '')"
    return f"nullif(regexp_replace({path}, '/+$', ''), '')"


def _reference(c: str) -> str:
    return f"coalesce('doi:' || {_doi(c)}, 'repo:' || {_repo(c)})"


_GROUPS = """
    own AS (SELECT id, {own} AS k FROM scholarly_document WHERE {own} IS NOT NULL),
    alt AS (SELECT DISTINCT a.document_id AS id, {alt} AS k FROM document_alternate_doi a SEMI JOIN scholarly_document d ON d.id = a.document_id WHERE {alt} IS NOT NULL),
    named AS (SELECT * FROM own UNION SELECT * FROM alt),
    edge AS (SELECT DISTINCT a.id AS u, b.id AS v FROM named a JOIN named b ON a.k = b.k AND a.id <> b.id),
    reach(u, v) AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
    member AS (SELECT u AS id, least(u, min(v)) AS first_id FROM reach GROUP BY u),
    old AS (SELECT DISTINCT o.id FROM own o JOIN alt a ON a.k = o.k AND a.id <> o.id)
""".format(own=_doi("doi"), alt=_doi("a.doi"))

_FIELDS = {"open_alex_id": 1, "title": 1, "publication_date": 0, "fwci": 0, "document_type": 1, "is_open_access": 0, "open_access_status": 1, "cited_by_percentile_year_min": 0, "cited_by_percentile_year_max": 0}


def _whole(c: str) -> str:
    if not _FIELDS[c]:
        return f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 0 WHEN regexp_matches(rtrim({c}), '(…|\\.\\.\\.)$') THEN 1 ELSE 2 END"


_ORDER = "CASE WHEN id IN (SELECT id FROM old) THEN 0 ELSE 1 END DESC, filled DESC, greatest(updated_datetime, created_datetime) DESC NULLS LAST, id"
_RANKED = f"""
    member_row AS (SELECT d.*, m.first_id, {' + '.join(f'{_whole(c)} * {2 - t}' for c, t in _FIELDS.items())} AS filled FROM scholarly_document d JOIN member m USING (id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY {_ORDER}) AS rn,
        {', '.join(f'row_number() OVER (PARTITION BY first_id ORDER BY {_whole(c)} DESC, {_ORDER}) AS rn_{c}' for c in _FIELDS)} FROM member_row)
"""



def _label(c: str, labels: tuple[str, ...]) -> str:
    letters = f"regexp_replace(lower({c}), '[^\\p{{L}}]', '', 'g')"
    return f"(SELECT CASE WHEN count(*) = 1 THEN min(l) END FROM (SELECT unnest({list(labels)}) AS l) WHERE {letters} <> '' AND starts_with(l, {letters}))"


def _votes() -> str:
    parts = []
    for q, labels, wide in (("contrib_type", ("code", "docs", "other"), "contrib-type"), ("is_actually_author", ("no", "unclear", "yes"), "is_actually_author")):
        for who in ("eva", "nic"):
            parts.append(f"SELECT u.unit_id, '{q}' AS question, '{who}' AS annotator, {_label(f'u."{who}-{wide}"', labels)} AS answer, TIMESTAMP '0001-01-01' AS told_at FROM cc_na_initial_unresolved_set u")
        parts.append(f"SELECT a.unit_id, '{q}', a.annotator, {_label(f'a.{q}', labels)}, coalesce(a.labelled_datetime, TIMESTAMP '0001-01-01') FROM cc_na_annotation a")
    rows = " UNION ALL ".join(parts)
    return f"SELECT unit_id, question, annotator, answer FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, question, annotator ORDER BY told_at DESC, answer DESC) AS rn FROM ({rows}) WHERE answer IS NOT NULL AND unit_id IS NOT NULL AND annotator IS NOT NULL) WHERE rn = 1"


# One visual form, written for these tables only and apart from the operator: characters that aren't seen,
# ligatures, full width by arithmetic on code points, and the letters of these texts.
_UNSEEN = "[\\x{AD}\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FE00}-\\x{FE0F}\\x{FEFF}]+"
_WIDE = "(SELECT string_agg(chr(CAST(c + {0} AS INTEGER)), '' ORDER BY c) FROM range(33, 127) t(c))"
_SPACES = "(SELECT string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY c) FROM (SELECT unnest([160, 5760, 8239, 8287, 12288]) AS c UNION SELECT range FROM range(8192, 8203)))"
_SEEN = ("АВЕКМНОРСТУХІЈЅаеорсухіјѕЇїЁёӒӓӦӧӰӱӖӗЀѐГПФΑΒΕΖΗΙΚΜΝΟΡΤΥΧονόΆΈΊΌΎΪΫµ∆∑‐‑", "ABEKMHOPCTYXIJSaeopcyxijsÏïËëÄäÖöŸÿĔĕÈèΓΠΦABEZHIKMNOPTYXovóÁÉÍÓÝÏŸμΔΣ--")
_LOW = ("вкмнтгпфαβεζηικμρτυχςάέίύϊϋ", "bkmhtγπφabezhikmptyxσáéíýïÿ")


def _form(c: str) -> str:
    c = f"regexp_replace(nfc_normalize({c}), '{_UNSEEN}', '', 'g')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ή", "H\u0301")):
        c = f"replace({c}, '{a}', '{b}')"
    c = f"translate({c}, {_WIDE.format(65248)}, {_WIDE.format(0)})"
    c = f"translate({c}, {_SPACES}, repeat(' ', 16))"
    return f"nfc_normalize(translate(nfc_normalize({c}), '{_SEEN[0]}', '{_SEEN[1]}'))"


def _words(table: str, id: str, joint: str) -> str:
    whole = f"regexp_replace(text, '[-‐‑－\\x{{AD}}][\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]*[ \\t]*\\r?\\n[ \\t>|]*', '{joint}', 'g')"
    low = f"replace(lower({_form(whole)}), 'ß', 'ss')"
    return f"SELECT {id}, list_filter(string_split_regex(nfc_normalize(translate({low}, '{_LOW[0]}', '{_LOW[1]}')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS l FROM {table}"


def _grams(table: str, id: str, joints: tuple[str, ...]) -> str:
    lists = " UNION ALL ".join(_words(table, id, j) for j in joints)
    return f"SELECT DISTINCT {id}, unnest(list_transform(range(1, len(l) - {WORDS - 2}), lambda i: array_to_string(list_slice(l, i, i + {WORDS - 1}), ' '))) AS gram FROM ({lists})"


# Texts with a broken word are read with all of them joined and all apart.
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id', ('', ' '))}) JOIN ({_grams('eval_item', 'item_id', ('',))}) USING (gram)"

SQL = {
    "p8_found": _LEAKS,
    "p8_items": f"SELECT item_id, CAST(count(*) AS BIGINT) AS n_documents FROM ({_LEAKS}) GROUP BY 1",
    "p1_found": f"WITH RECURSIVE {_GROUPS}, {_RANKED} SELECT first_id, id AS survivor_id FROM ranked WHERE rn = 1",
    "p1_best_record": f"""WITH RECURSIVE {_GROUPS}, {_RANKED}
        SELECT first_id, max(id) FILTER (WHERE rn = 1) AS survivor_id, max(doi) FILTER (WHERE rn = 1) AS doi, CAST(count(*) AS BIGINT) AS n_members,
        {', '.join(f'max({c}) FILTER (WHERE rn_{c} = 1) AS {c}' for c in _FIELDS)}, max(cited_by_count) AS cited_by_count FROM ranked GROUP BY first_id""",
    "p5_found": """WITH RECURSIVE
        edge AS (SELECT DISTINCT researcher_id AS r, developer_account_id AS a FROM researcher_developer_account_link
            WHERE predictive_model_confidence >= 0.97 AND NOT isnan(predictive_model_confidence) AND researcher_id IS NOT NULL AND developer_account_id IS NOT NULL),
        step AS (SELECT DISTINCT e.r AS u, f.r AS v FROM edge e JOIN edge f ON e.a = f.a),
        reach(u, v) AS (SELECT u, v FROM step UNION SELECT r.u, s.v FROM reach r JOIN step s ON r.v = s.u),
        root AS (SELECT u AS r, min(v) AS group_id FROM reach GROUP BY u)
        SELECT group_id, 'researcher' AS record_kind, r AS record_id FROM root
        UNION ALL SELECT DISTINCT group_id, 'account', a FROM edge JOIN root USING (r)""",
    "p6_found": f"""WITH c AS (SELECT raw_id, {_reference('repo_url')} AS a, {_reference('paper_doi')} AS b FROM basic_repository_document_pair),
        g AS (SELECT raw_id, min(raw_id) OVER w AS group_id, count(*) OVER w AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY least(a, b), greatest(a, b)))
        SELECT group_id, raw_id FROM g WHERE n > 1""",
    "p6_collapsed": f"""WITH c AS (SELECT raw_id, {_reference('repo_url')} AS a, {_reference('paper_doi')} AS b FROM basic_repository_document_pair)
        SELECT min(raw_id) AS group_id, CAST(count(*) AS BIGINT) AS n_copies FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY least(a, b), greatest(a, b)""",
    "p9_found": f"""WITH c AS (SELECT doc_id, text, {_form('text')} AS s4 FROM documents)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.s4 = b.s4 AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p9_canonical": f"SELECT doc_id, {_form('text')} AS text FROM documents",
    "p9_classes": f"""WITH c AS (SELECT doc_id, text, {_form('text')} AS s4 FROM documents),
        g AS (SELECT s4, min(doc_id) AS class_id, CAST(count(DISTINCT text) AS BIGINT) AS n_forms FROM c GROUP BY s4)
        SELECT doc_id, class_id, n_forms FROM c JOIN g USING (s4) WHERE n_forms > 1""",
    "p2_agreement": f"""WITH v AS ({_votes()}),
        m AS (SELECT question, unit_id, count(*) AS m FROM v GROUP BY ALL HAVING count(*) > 1),
        l AS (SELECT v.question, v.unit_id, v.answer, count(*) AS n FROM v JOIN m USING (question, unit_id) GROUP BY ALL),
        s AS (SELECT question, unit_id, sum(n * n) AS same FROM l GROUP BY ALL),
        o AS (SELECT question, count(*) AS n_units, sum(m) AS n_answers, sum((m * m - same) / CAST(m - 1 AS DOUBLE)) AS apart FROM m JOIN s USING (question, unit_id) GROUP BY ALL),
        c AS (SELECT question, sum(c * c) AS cc FROM (SELECT question, answer, sum(n) AS c FROM l GROUP BY ALL) GROUP BY ALL)
        SELECT question, CAST(n_units AS BIGINT) AS n_units, CAST(n_answers AS BIGINT) AS n_answers, CAST(apart / n_answers AS DOUBLE) AS observed,
            CAST((n_answers * n_answers - cc) / CAST(n_answers * (n_answers - 1) AS DOUBLE) AS DOUBLE) AS expected,
            CAST(1 - (apart / n_answers) / ((n_answers * n_answers - cc) / CAST(n_answers * (n_answers - 1) AS DOUBLE)) AS DOUBLE) AS alpha
        FROM o JOIN c USING (question)""",
}
