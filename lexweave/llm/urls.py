"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BYTES = 4
#: The rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


class Url(NamedTuple):
    host: Column
    path: Column


def parts(url: Column) -> Url:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return Url(host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with their full digest and its short prefix.

    Of rules with the same host and path the block stays; rules with a null are no rules.
    """
    clean = rules.select("verdict", F.lower("host").alias("r_host"), F.col("path").alias("r_path")).dropna()
    one = clean.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    full = digest(F.col("r_host"), F.col("r_path"))
    return one.select("*", full.alias("full"), F.substring(full, 1, 2 * PREFIX_BYTES).alias("short"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The ``keep`` columns of every row with ``host``, ``path``, ``rule`` and ``verdict``.

    Each distinct (host, path) is expanded into its host suffixes, from the whole host down to
    the last label, times the prefixes of its path, as long as some rule's path is long. The distinct expressions meet the
    rules on the first bytes of the digest; full digests confirm; what is met goes back to the URLs. The longest rule (host and path)
    wins, then the longer host. Null, empty and malformed URLs have no expressions and get the
    default; repeated rows are judged each; without rules all get the default. Columns of ``keep``
    must not be called host, path, rule or verdict.
    """
    known = compile_rules(rules)
    longest = known.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"))
    u = parts(F.col(url))
    rows = pages.select(*keep, u.host.alias("host"), u.path.alias("path"))
    distinct = rows.where("host != ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sized = distinct.join(F.broadcast(longest))  # one row: the distinct lengths of rule paths
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (sized.select("host", "path", F.explode(suffixes).alias("e_host"), prefixes.alias("ps"))
                .select("host", "path", "e_host", F.explode("ps").alias("e_path")))
    full = digest(F.col("e_host"), F.col("e_path"))
    keyed = expanded.select("host", "path", full.alias("e_full"), F.substring(full, 1, 2 * PREFIX_BYTES).alias("short"))
    exprs = keyed.select("e_full", "short").distinct()  # "com/" is one expression, however many URLs have it
    met = keyed.select("host", "path", "e_full").join(exprs.join(known, "short").where("e_full = full").drop("short", "full"), "e_full")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.r_verdict")
    return rows.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))
