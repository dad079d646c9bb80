"""URL filter: allow and block entries in a trie over reversed host labels and path segments.

A rule is (host, path): it fits its host and every subdomain when the url's path starts with the
rule's path. The longest match wins: more host labels first, then the longer path. If the same
(host, path) is listed as allow and block, allow wins.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the default
verdict; an empty path does not start with ``/``. Rows are judged one by one, so repeated rows and
ties stay as they are; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, table

#: Pickled size up to which the trie is broadcast; larger rule sets go through a join.
MAX_TRIE_BYTES = 64 << 20

#: The rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


class UrlTrie:
    """Nodes are dicts. Host labels lead from the root, ``/`` leads to the path's segments.

    A path node has its children by whole segment and its rules by the beginning of the next
    segment, as a rule's path may end inside a segment.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("", {})
            if last not in ends or verdict == "allow":
                ends[last] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule string and verdict of the longest match."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                best = self._path(node["/"], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = node.get("")
            if ends:
                longest = max((x for x in ends if segment.startswith(x)), key=len, default=None) if len(ends) <= len(segment) else next((segment[:k] for k in range(len(segment), -1, -1) if segment[:k] in ends), None)
                best = ends[longest] if longest is not None else best
            node = node.get("/" + segment)
            if node is None:
                break
        return best


def host_and_path(url):
    """Columns (host, path) of a url column; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, url: str, rules: list[tuple[str, str, str]], keep: list[str], default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``keep`` columns and host, path, rule, verdict for every row of ``df``."""
    host, path = host_and_path(F.col(url))
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    trie = UrlTrie(rules)
    if len(pickle.dumps(trie.root)) > max_trie_bytes:
        return _judge_by_join(rows, rules, default)
    shipped = df.sparkSession.sparkContext.broadcast(trie.root)

    @F.pandas_udf("rule string, verdict string")
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        own = UrlTrie(())
        own.root = shipped.value
        return pd.DataFrame([own.match(h, p) or (None, default) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return rows.withColumn("_m", verdicts("host", "path")).select(*keep, "host", "path", "_m.rule", "_m.verdict")


def _judge_by_join(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same for rule sets beyond the broadcast limit: distinct urls, exploded host suffixes, equi-join."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(h.lower(), p, v, h + p) for v, h, p in rules], "_h string, _p string, verdict string, rule string")
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = urls.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("_h", F.concat_ws(".", F.slice(labels, F.col("_i"), F.lit(1 << 20))))
    fit = suffixes.join(listed, "_h").where(F.col("path").startswith(F.col("_p")))
    best = fit.groupBy("host", "path").agg(F.max(F.struct((-F.col("_i")).alias("a"), F.length("_p").alias("b"), (F.col("verdict") == "allow").alias("c"), "rule", "verdict")).alias("_m"))
    kept = [c for c in rows.columns if c not in ("host", "path")]
    return rows.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.verdict"), F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), "url", RULES, ["page_id"])


OP1_SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path
  FROM r
), m AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
