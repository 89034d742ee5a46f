"""Host, owner and name of a repository address (F-01 to F-04), as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The address forms of each host, in the order in which they are tried. A later host
# that also fits takes precedence over an earlier one.
FORMS = {
    "github": ["github.com/{owner}/{repo}/", "{owner}.github.io/{repo}/", "{owner}.github.com/{repo}", "github.com/{owner}/", "{owner}.github.io/", "{owner}.github.com/"],
    "gitlab": ["gitlab.com/{owner}/{repo}/", "{owner}.gitlab.io/{repo}/", "{owner}.gitlab.com/{repo}/", "gitlab.com/{owner}/", "{owner}.gitlab.io/", "{owner}.gitlab.com/"],
    "bitbucket": ["bitbucket.org/{owner}/{repo}/"],
    "sourceforge": ["sourceforge.net/projects/{repo}/"],
}
# Texts of the errors.
UNPARSED, OTHER_HOST = "Could not parse code host URL", "Not a GitHub repository"


def pattern(form: str, field: str) -> str | None:
    """Regular expression of a form that captures `field` as shortly as the whole address allows."""
    if "{" + field + "}" not in form:
        return None
    parts = re.split(r"\{(\w+)\}", form)
    body = "".join(("(.+?)" if p == field else "(?:.+?)") if i % 2 else re.escape(p).replace("/", "/").replace("\\-", "-") for i, p in enumerate(parts))
    return f"(?is)\\A{body}\\z"


def tidy_url(url: Column) -> Column:
    """Lower case, trimmed, without scheme and `www.` anywhere, with a slash at the end."""
    s = F.lower(F.regexp_replace(url, "(?U)^\\s+|\\s+$", ""))
    for gone in ("https://", "http://", "www."):
        s = F.replace(s, F.lit(gone), F.lit(""))
    return F.when(s.endswith("/"), s).otherwise(F.concat(s, F.lit("/")))


def clean_name(name: Column, compat: bool = False) -> Column:
    """The name up to the first slash without a final `.git`; with `compat`, without any `.git`."""
    head = F.split_part(name, F.lit("/"), F.lit(1))
    return F.replace(head, F.lit(".git"), F.lit("")) if compat else F.regexp_replace(head, "\\.git$", "")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def parse_code_host(url: Column, compat: bool = False) -> Column:
    """struct<host, owner, name, error> of an address.

    Null, empty and blank addresses, and those of other hosts, have an error. All hosts but
    SourceForge need an owner, SourceForge a name. `compat` keeps a known slip: every `.git` is
    removed from a name, not only a final one.
    """
    none = F.lit(None).cast("string")

    def found(s: Column) -> Column:
        hosts = []
        for h, forms in FORMS.items():
            fits = []
            for f in forms:
                own, rep = pattern(f, "owner"), pattern(f, "repo")
                parts = F.struct(F.lit(h).alias("host"), (F.regexp_extract(s, own, 1) if own else none).alias("owner"), (F.regexp_extract(s, rep, 1) if rep else none).alias("name"))
                fits.append(F.when(s.rlike(own or rep), parts))
            hosts.append(F.coalesce(*fits))
        return F.coalesce(*reversed(hosts))

    def result(p: Column) -> Column:
        known = F.coalesce(F.when(p["host"] == "sourceforge", p["name"].isNotNull()).otherwise(p["owner"].isNotNull()), F.lit(False))
        return F.struct(
            F.when(known, p["host"]).alias("host"), F.when(known, p["owner"]).alias("owner"), F.when(known, clean_name(p["name"], compat)).alias("name"),
            F.when(~known, UNPARSED).alias("error"),
        )

    return let(let(tidy_url(url), found), result)


def split_pairs(pairs: DataFrame, url: str = "repo_url", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs on the first host with owner and name, error rows) of landed pairs (SO-04, D-37)."""
    parsed = pairs.withColumn("_p", parse_code_host(F.col(url), compat))
    good = (F.col("_p.host") == "github") & F.col("_p.owner").isNotNull() & F.col("_p.name").isNotNull()
    good = F.coalesce(good, F.lit(False))
    ok = parsed.where(good).select(*pairs.columns, F.col("_p.host").alias("host"), F.col("_p.owner").alias("owner"), F.col("_p.name").alias("name"))
    bad = parsed.where(~good).select(
        F.col("source"), F.lit("code-host-parsing").alias("step"), F.col("paper_doi").alias("identifier"),
        F.coalesce(F.col("_p.error"), F.lit(OTHER_HOST)).alias("error"), F.lit("").alias("traceback"),
    )
    return ok, bad
