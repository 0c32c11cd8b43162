"""URL rules in a trie over reversed host labels and then path segments, broadcast to the executors.

The longest match wins: first the rule with more host labels, then the one with the longer path. A rule path is a
prefix of the url's path and may end within a segment; such ends hang on the node of the last whole segment.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

#: Rules (verdict, host, path) that the query judges by.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The trie travels to each executor whole; if it takes more bytes than this, the operator refuses.
MAX_TRIE_BYTES = 16 << 20

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host with A-Z lower-cased. Null or no '://': both empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    cut = rest.find("/", 0, end)
    cut = end if cut < 0 else cut
    return rest[:cut].translate(_UPPER), rest[cut:end]


class Trie:
    """Nested dicts. A host node keeps its path trie under None; a path node keeps its rules under ''."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("seg", segment), {})
            ends = node.setdefault("", {})
            old = ends.get(last)
            ends[last] = (verdict if old is None or verdict == "block" else old[0], f"{host}{path}")  # the same rule twice: block

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node and (hit := self._path(node[None], path)):
                found = hit  # more host labels: this one goes before
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            if ends := node.get(""):
                for size in range(len(segment), -1, -1):
                    if (hit := ends.get(segment[:size])) is not None:
                        found = hit
                        break
            node = node.get(("seg", segment)) if i < len(segments) - 1 else None
            if node is None:
                break
        return found


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages(page_id, url, ...).

    No rule fits: rule is null, verdict the default. Null url or one without '://': host and path are empty, and no
    rule with a host fits. The same rule twice, with both verdicts: block. Urls of any length are judged whole. Repeated rows and null page_ids stay; other columns are ignored; empty table: no rows.
    """
    ship(pages.sparkSession)
    tree = Trie(rules)
    if len(pickle.dumps(tree)) > MAX_TRIE_BYTES:
        raise ValueError("too many rules to broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        tree, rows = trie.value, []
        for url in urls:
            host, path = split_url(url)
            hit = tree.match(host, path)
            rows.append((host, path, hit[1] if hit else None, hit[0] if hit else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.select("page_id", verdicts("url").alias("found")).select("page_id", "found.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = r"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages
), parts as (
  select page_id, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') as raw_host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), named as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits as (
  select n.page_id, n.host, n.path, r.rule_host || r.rule_path as rule, r.verdict,
         row_number() over (partition by n.page_id order by length(r.rule_host) desc, length(r.rule_path) desc) as k
  from named n left join rules r
    on (n.host = r.rule_host or ends_with(n.host, '.' || r.rule_host)) and starts_with(n.path, r.rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1
"""
