"""URL filter: hashed host-suffix / path-prefix expressions against allow and block rules.

Every URL is expanded into the expressions that a rule of the set could have
(so many trailing host labels, so many leading path characters), the
expressions are joined to the rules on a short prefix of their SHA-256, and
only full digests count as a hit. The longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as (rule, verdict, n_labels, path_len, digest, prefix).

    A rule without host is ignored, a null path is empty. Of equal rules with
    different verdicts ``block`` holds.
    """
    clean = rules.filter(F.length("host") > 0).select(
        ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    )
    merged = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    return merged.select(
        rule.alias("rule"),
        "rule_verdict",
        F.size(F.split("rule_host", r"\.")).alias("n_labels"),
        F.length("rule_path").alias("path_len"),
        F.sha2(rule, 256).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """All rows of ``urls`` with host, path, rule and verdict added.

    * Null url or one without ``://``: empty host and path, no rule, the default verdict.
    * Repeated rows are each judged; an empty table gives an empty result.
    * Equally long rules: block before allow, then the greater rule string.
    * Columns of the input named host, path, rule or verdict are replaced.

    The number of expressions per URL is the number of distinct (labels, path
    length) shapes of the rules, which is what is read to the driver. Matches
    are reduced per URL before the rows are joined back, so a URL repeated many
    times costs one row per task; the join back is one Spark can split.
    """
    compiled = compile_rules(rules)
    shapes = [(r.n_labels, r.path_len) for r in compiled.select("n_labels", "path_len").distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    keyed = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not shapes:
        return keyed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.size(F.split("host", r"\."))
    expressions = F.array(
        *(
            F.when(
                (labels >= n) & (F.length("path") >= k),
                F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)),
            )
            for n, k in sorted(shapes)
        )
    )
    expanded = keyed.filter(F.length("host") > 0).select(
        F.col(url_col).alias("_url"), F.explode(F.array_compact(expressions)).alias("expression")
    )
    hashed = expanded.select("_url", F.sha2("expression", 256).alias("url_digest")).withColumn(
        "prefix", F.substring("url_digest", 1, PREFIX_HEX)
    )
    hits = hashed.join(compiled, "prefix").filter(F.col("url_digest") == F.col("digest"))
    order = F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")
    best = hits.groupBy(F.col("_url").alias("__judged_url")).agg(F.max(order).alias("__judged"))
    return keyed.join(best, keyed[url_col] == best["__judged_url"], "left").select(
        *(keyed[c] for c in keyed.columns),
        F.col("__judged.rule").alias("rule"),
        F.coalesce("__judged.rule_verdict", F.lit(default)).alias("verdict"),
    )
