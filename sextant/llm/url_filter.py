"""URL filters: a broadcast trie over reversed host labels, then path segments.

A rule (host, path, verdict) fits a URL whose host is the rule's host or a subdomain of it
and whose path starts with the rule's path. Of all fitting rules, allow and block alike, the
longest (characters of host and path together) wins; of two as long, that with the longer
host, then the blocking one. So a rule never depends on the order in which rules are listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import _LOWER, _UPPER

Rule = tuple[str, str, str]


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right ("next"), then whole path segments ("below").

    A node's "ends" holds, for each rule whose whole segments lead there, the start that the
    next segment must have and the rule's rank; the rule with the greatest rank wins.
    """
    root: dict = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("next", {}).setdefault(label, {})
        *whole, start = path.split("/")
        for segment in whole:
            node = node.setdefault("below", {}).setdefault(segment, {})
        rank = (len(host) + len(path), len(host), verdict == "block")
        node.setdefault("ends", []).append((start, rank, host + path, verdict))
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning rule and its verdict, or None."""
    best, segments, node = None, path.split("/"), trie
    for label in reversed(host.split(".")):
        node = node.get("next", {}).get(label)
        if node is None:
            break
        at = node
        for k, segment in enumerate(segments):
            for start, *rest in at.get("ends", ()):
                if segment.startswith(start) and (best is None or rest > best):
                    best = rest
            at = at.get("below", {}).get(segment) if k + 1 < len(segments) else None
            if at is None:
                break
    return (best[1], best[2]) if best else None


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path goes on to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both
    empty; it gets ``default`` like any URL that no rule fits, with a null ``rule``.
    The rules are a hand-kept list: the trie is built on the driver and broadcast; its size
    follows the list, not the data. An empty table gives an empty result.
    """
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [longest(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    host, path = split_url(F.col(url))
    return (
        df.withColumns({"host": host, "path": path})
        .withColumn("_judged", judge("host", "path"))
        .withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")})
        .drop("_judged")
    )
