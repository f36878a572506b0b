"""URL filters: rules on host and path, found by short hash prefixes of host-suffix/path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    after = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(after, "?", 1), "#", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_suffixes(host: Column, most: Column) -> Column:
    """The last 1, 2, ... labels of the host (joined by dots), `most` at most."""
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), most)
    return F.when(
        host != "",
        F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, -k, k), ".")),
    ).otherwise(F.array().cast("array<string>"))


def path_stems(path: Column, most: Column) -> Column:
    """The path's prefixes that end at a slash, `most` at most, and the empty prefix."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, most)
    cut = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))).otherwise(""),
    )
    return cut


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the expression they are found by.

    The expression is the host and the path up to its last slash; what follows the last slash is
    compared when the candidates are confirmed. Repeated rules count once; if verdicts differ, block wins.
    A null path is empty; a null or empty host drops the rule, as it can fit nothing.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    plain = rules.where(F.col("host") != "").groupBy(host.alias("_host"), path.alias("_path")).agg(
        F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise(F.max("verdict")).alias("_verdict")
    )
    stem = F.regexp_extract("_path", r"(?s)^(.*/)?", 1)
    digest = F.sha2(F.concat("_host", F.lit("\n"), stem), 256)
    return plain.select(
        "_host", "_path", "_verdict", digest.alias("_digest"), F.substring(digest, 1, PREFIX_HEX).alias("_prefix")
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """`pages` with columns host, path, rule and verdict, of the longest rule that fits.

    A rule fits its host and every subdomain of it when the url's path starts with the rule's.
    Every distinct (host, path) is expanded once into host suffixes times path stems, no deeper than
    the deepest rule; expressions meet rules by the first digits of their digests, then full digests
    and the rest of the path are compared and the longest rule (ties: longer host) is kept. Urls that
    no rule fits get `default`; so do null urls and those without `://`, whose host and path are empty.
    Columns of `pages` named host, path, rule or verdict are replaced. All rows are kept, repeated
    ones too; without rules every row gets `default`.
    """
    known = rule_table(rules)
    depth = known.agg(
        F.coalesce(F.max(F.size(F.split("_host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.size(F.split("_path", "/")) - 1), F.lit(0)),
    ).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    expressions = (
        judged.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"), F.lit(depth[0]))).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(path_stems(F.col("path"), F.lit(depth[1]))).alias("_stem"))
        .select("host", "path", F.sha2(F.concat("_suffix", F.lit("\n"), "_stem"), 256).alias("_full"))
        .withColumn("_prefix", F.substring("_full", 1, PREFIX_HEX))
    )
    fits = expressions.join(known, "_prefix").where(
        (F.col("_full") == F.col("_digest")) & F.col("path").startswith(F.col("_path"))
    )
    rank = F.struct(
        (F.length("_host") + F.length("_path")).alias("n"),
        F.length("_host").alias("h"),
        F.concat("_host", "_path").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    return judged.select(*kept, "host", "path").join(best, ["host", "path"], "left").select(
        *kept,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
