"""Queries of the training-data problems; `__spark_entry__` adds them if this package is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.llm.components import match_groups
from quillgraph.llm.consensus import agreement, discover, votes
from quillgraph.llm.formatting import collapse, copies
from quillgraph.llm.leakage import decontaminate, leaks
from quillgraph.llm.lookalikes import canonical_texts, look_classes, look_pairs
from quillgraph.llm.matching import match_people
from quillgraph.llm.packing import fill_containers, fill_report
from quillgraph.llm.representatives import best_records, survivors
from quillgraph.llm.sql import SQL  # noqa: F401
from quillgraph.runtime import read


def p1_found(spark, d):
    return survivors(read(spark, d, "scholarly_document"), read(spark, d, "document_alternate_doi"))


def p1_best_record(spark, d):
    return best_records(read(spark, d, "scholarly_document"), read(spark, d, "document_alternate_doi"))


def _votes(spark, d):
    return votes(read(spark, d, "cc_na_initial_unresolved_set"), read(spark, d, "cc_na_annotation"))


def p2_found(spark, d):
    return discover(_votes(spark, d)).labels.select("unit_id", "question", "label")


def p2_reliability(spark, d):
    return discover(_votes(spark, d)).annotators


def p2_agreement(spark, d):
    return agreement(_votes(spark, d))


def p3_found(spark, d):
    return p3_confidence(spark, d).select("researcher_id", "developer_account_id")


def p3_confidence(spark, d):
    return match_people(read(spark, d, "researcher"), read(spark, d, "developer_account")).select("researcher_id", "developer_account_id", "confidence")


def p5_found(spark, d):
    return match_groups(read(spark, d, "researcher_developer_account_link"))


def p6_found(spark, d):
    return copies(read(spark, d, "basic_repository_document_pair"))


def p6_collapsed(spark, d):
    return collapse(read(spark, d, "basic_repository_document_pair")).select("group_id", "n_copies")


def p7_assignment(spark, d):
    return fill_containers(read(spark, d, "documents"))


def p7_fill(spark, d):
    return fill_report(p7_assignment(spark, d))


def p8_found(spark, d):
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_item"))


def p8_items(spark, d):
    """Which items leaked, and into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_cleaned(spark, d):
    return decontaminate(read(spark, d, "documents"), read(spark, d, "eval_item"))


def p9_found(spark, d):
    return look_pairs(read(spark, d, "documents"))


def p9_canonical(spark, d):
    return canonical_texts(read(spark, d, "documents"))


def p9_classes(spark, d):
    return look_classes(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_best_record, p2_found, p2_reliability, p2_agreement, p3_found, p3_confidence, p5_found, p6_found, p6_collapsed, p7_assignment, p7_fill, p8_found, p8_items, p8_cleaned, p9_found, p9_canonical, p9_classes)}

