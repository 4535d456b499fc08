"""URL filter: a trie over reversed host labels, and at each host a trie over path segments.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path starts with the rule's
path. Among all that fit, the longest rule wins (host plus path, then host); a url that no rule fits gets the default
verdict; of rules for one host and path, block wins. The trie holds the rules only, at most ``MAX_RULES``, and is broadcast;
urls are judged in Arrow batches without any shuffle. More rules, or rules in a table, are joined instead, with the same
result: distinct (host, path) pairs meet the rules by host suffix and path prefix, at most once for each length that the
host's rules have; nothing is broadcast by hint.

A null url, or one without ``://``, has an empty host and path and gets the default verdict. Columns of the input
named host, path, rule or verdict are replaced. Empty tables and repeated rows need no care.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cattedra.llm.common import ASCII_LOWER, LOWER, UPPER, no_clash, ship

#: Bound of the broadcast: about 200 bytes a rule.
MAX_RULES = 500_000
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def parse_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?``, ``#`` or the end)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(ASCII_LOWER), path


class HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class PathNode:
    """``ends``: last, possibly partial, segment of a rule -> (verdict, rule); ``lengths``: theirs, longest first."""

    __slots__ = ("segments", "ends", "lengths")

    def __init__(self):
        self.segments: dict[str, PathNode] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []


def build_trie(rules: list[tuple[str, str, str]]) -> HostNode:
    """Rules for one host and path: block wins over allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} may be broadcast")
    root = HostNode()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.setdefault(label, HostNode())
        node.paths = at = node.paths or PathNode()
        *full, last = path.split("/")
        for segment in full:
            at = at.segments.setdefault(segment, PathNode())
        if at.ends.get(last, ("allow",))[0] != "block":
            at.ends[last] = (verdict, host + path)
        if len(last) not in at.lengths:
            at.lengths = sorted([*at.lengths, len(last)], reverse=True)
    return root


def _longest_path(node: PathNode, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        # one look for each length of rule that ends here, however many rules do
        best = next((node.ends[segment[:n]] for n in node.lengths if segment[:n] in node.ends), best)
        node = node.segments.get(segment)
        if node is None:
            break
    return best


def judge_url(root: HostNode, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits, or None."""
    found, node, segments = None, root, path.split("/")
    for label in [None, *reversed(host.split("."))] if host else [None]:
        if label is not None:
            node = node.labels.get(label)
            if node is None:
                break
        hit = node.paths and _longest_path(node.paths, segments)
        if hit and (found is None or len(hit[1]) >= len(found[1])):
            found = hit
    return found


def _url_parts(url: Column) -> tuple[Column, Column]:
    """``parse_url`` in Spark functions."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``judge`` with the rules (verdict, host, path) as a table of any size. Rules with a null take no part."""
    base = no_clash(df, "host", "path", "rule", "verdict")
    host, path = _url_parts(F.col(url))
    urls = base.withColumns({"host": host, "path": path})
    rules = (rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("__verdict"))
             .withColumn("__length", F.char_length("path")))
    # as many lengths a host as its longest rule has characters, at most
    lengths = rules.groupBy(F.col("host").alias("__suffix")).agg(F.collect_set("__length").alias("__lengths"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    ends = F.array_distinct(F.concat(F.array(F.lit("")), ends))
    pairs = urls.select("host", "path").distinct()
    met = pairs.select("*", F.explode(ends).alias("__suffix")).join(lengths, "__suffix")
    met = met.select("host", "path", "__suffix", F.explode("__lengths").alias("__length")).where(F.col("__length") <= F.char_length("path"))
    met = met.withColumn("__prefix", F.substr("path", F.lit(1), F.col("__length")))
    rules = rules.select(F.col("host").alias("__suffix"), F.col("path").alias("__prefix"), "__verdict")
    text = F.concat("__suffix", "__prefix")
    best = met.join(rules, ["__suffix", "__prefix"]).groupBy("host", "path").agg(
        F.max_by(F.struct(text.alias("rule"), F.col("__verdict").alias("verdict")),
                 F.struct(F.char_length(text), F.char_length("__suffix"))).alias("__hit"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*base.columns, "host", "path", F.col("__hit.rule").alias("rule"),
                      F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule (null if none fits) and verdict."""
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        return judge_by_join(df, rules, url, default)
    if len(rules) > MAX_RULES:
        return judge_by_join(df, spark.createDataFrame(rules, "verdict string, host string, path string"), url, default)
    ship(spark)
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        root, out = trie.value, []
        for u in urls:
            host, path = parse_url(u)
            hit = judge_url(root, host, path)
            out.append((host, path, hit and hit[1], hit[0] if hit else default))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    base = no_clash(df, "host", "path", "rule", "verdict")
    judged = base.select("*", verdicts(F.col(url)).alias("__judged"))
    return judged.select(*base.columns, "__judged.*")
