"""The 21 tables of the graph: columns, natural keys and foreign keys."""

from __future__ import annotations

from pyspark.sql import types as T

from quillgraph.operators.orphans import ForeignKey

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "D": T.DateType()}

# Name of the table, its natural key, its columns as name:type (a trailing ? allows null).
_TABLES = {
    "dataset_source": ("name", "name:s"),
    "document": ("doi", "doi:s open_alex_id:s title:s publication_date:D cited_by_count:i cited_by_percentile_year_min:i cited_by_percentile_year_max:i fwci:d? document_type:s is_open_access:b open_access_status:s"),
    "document_alternate_doi": ("doi", "document_id:l doi:s"),
    "document_abstract": ("document_id", "document_id:l content:s?"),
    "topic": ("open_alex_id", "open_alex_id:s name:s field_name:s field_open_alex_id:s subfield_name:s subfield_open_alex_id:s domain_name:s domain_open_alex_id:s"),
    "document_topic": ("document_id topic_id", "document_id:l topic_id:l score:d"),
    "researcher": ("open_alex_id", "open_alex_id:s name:s works_count:i cited_by_count:i h_index:i i10_index:i two_year_mean_citedness:d"),
    "document_contributor": ("researcher_id document_id", "researcher_id:l document_id:l position:s is_corresponding:b"),
    "institution": ("open_alex_id", "open_alex_id:s name:s ror:s"),
    "document_contributor_institution": ("document_contributor_id institution_id", "document_contributor_id:l institution_id:l"),
    "funder": ("open_alex_id", "open_alex_id:s name:s"),
    "funding_instance": ("funder_id award_id", "funder_id:l award_id:s"),
    "document_funding_instance": ("document_id funding_instance_id", "document_id:l funding_instance_id:l"),
    "code_host": ("name", "name:s"),
    "repository": ("code_host_id owner name", "code_host_id:l owner:s name:s description:s? is_fork:b forks_count:i stargazers_count:i watchers_count:i open_issues_count:i size_kb:i creation_datetime:t last_pushed_datetime:t"),
    "repository_readme": ("repository_id", "repository_id:l content:s?"),
    "repository_language": ("repository_id language", "repository_id:l language:s bytes_of_code:l"),
    "developer_account": ("code_host_id username", "code_host_id:l username:s name:s? email:s?"),
    "repository_contributor": ("repository_id developer_account_id", "repository_id:l developer_account_id:l"),
    "document_repository_link": ("document_id repository_id", "document_id:l repository_id:l dataset_source_id:l predictive_model_name:s? predictive_model_version:s? predictive_model_confidence:d?"),
    "researcher_developer_account_link": ("researcher_id developer_account_id", "researcher_id:l developer_account_id:l predictive_model_name:s predictive_model_version:s predictive_model_confidence:d"),
}


def _schema(columns: str) -> T.StructType:
    fields = [T.StructField("id", T.LongType(), False)]
    for c in columns.split():
        name, kind = c.split(":")
        fields.append(T.StructField(name, _TYPES[kind[0]], kind.endswith("?")))
    return T.StructType([*fields, T.StructField("created_datetime", T.TimestampNTZType(), False), T.StructField("updated_datetime", T.TimestampNTZType(), True)])


SCHEMAS = {name: _schema(columns) for name, (_, columns) in _TABLES.items()}
KEYS = {name: key.split() for name, (key, _) in _TABLES.items()}


_DOCUMENT, _HOST = {"document_id": ("document", {"doi": "doi"})}, {"code_host_id": ("code_host", {"name": "host"})}
_REPOSITORY = _HOST | {"repository_id": ("repository", {"code_host_id": "code_host_id", "owner": "owner", "name": "name"})}
_RESEARCHER = {"researcher_id": ("researcher", {"open_alex_id": "researcher"})}

#: How rows with natural keys get their foreign ids, in order: id column, the table it refers to, and which
#: column of the row (or id found before) each part of that table's key is. Tables stand in order of storing.
REFERENCES = {
    "dataset_source": {}, "code_host": {}, "document": {},
    "document_alternate_doi": {"document_id": ("document", {"doi": "document_doi"})},
    "document_abstract": _DOCUMENT, "topic": {},
    "document_topic": _DOCUMENT | {"topic_id": ("topic", {"open_alex_id": "topic"})},
    "researcher": {}, "document_contributor": _DOCUMENT | _RESEARCHER, "institution": {},
    "document_contributor_institution": _DOCUMENT | _RESEARCHER | {
        "document_contributor_id": ("document_contributor", {"researcher_id": "researcher_id", "document_id": "document_id"}), "institution_id": ("institution", {"open_alex_id": "institution"}),
    },
    "funder": {}, "funding_instance": {"funder_id": ("funder", {"open_alex_id": "funder"})},
    "document_funding_instance": _DOCUMENT | {"funder_id": ("funder", {"open_alex_id": "funder"}), "funding_instance_id": ("funding_instance", {"funder_id": "funder_id", "award_id": "award_id"})},
    "repository": _HOST, "repository_readme": _REPOSITORY, "repository_language": _REPOSITORY, "developer_account": _HOST,
    "repository_contributor": _REPOSITORY | {"developer_account_id": ("developer_account", {"code_host_id": "code_host_id", "username": "username"})},
    "document_repository_link": _DOCUMENT | _REPOSITORY | {"dataset_source_id": ("dataset_source", {"name": "source"})},
    "researcher_developer_account_link": {},
}


def foreign_keys() -> list[ForeignKey]:
    """Every column `<table>_id` refers to that table."""
    return [ForeignKey(t, c, c[:-3]) for t, s in SCHEMAS.items() for c in s.names if c.endswith("_id") and c[:-3] in SCHEMAS]
