"""Allow and block rules for URLs, matched by a trie over reversed host labels and path segments.

A rule's host leads from the root over its labels, last label first; below the node of the host hang
its path segments. A URL walks down its own labels and, at every node on the way, down its path: all
rules that fit its host or a parent domain lie on these walks. The rule of most labels and segments
wins, whether it allows or blocks; of two such the one of the longer host.

The trie is broadcast when the rules are few enough, by their measured size. A larger table of rules
is joined instead: a URL's host suffixes and path prefixes are as many as it has labels and segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ready

ALLOW, BLOCK = "allow", "block"
RULE = "host string, path string, verdict string"
# Characters of all rules together up to which their trie is broadcast.
TRIE_CHARS = 20_000_000
# Hosts whose walk a task remembers; forgetting costs time, not results.
HOSTS = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Node:
    """A trie node: the labels or segments below it, the paths of its host, and the rules that end in it."""

    __slots__ = ("below", "paths", "rests")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        # What a rule's path ends with after its last slash -> (rule, verdict): '' for a path that ends in a slash.
        self.rests: dict[str, tuple[str, str]] = {}

    def child(self, name: str) -> Node:
        return self.below.setdefault(name, Node())


class Trie:
    """Rules (host, path, verdict) for the walks described above. Of rules that say both, block stays."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root = Node()
        self.known: dict[str, list[tuple[int, Node]]] = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.child(label)
            if node.paths is None:
                node.paths = Node()
            node = node.paths
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.child(segment)
            if node.rests.get(rest, ("", ALLOW))[1] == ALLOW:
                node.rests[rest] = host + path, verdict

    def hosts(self, host: str) -> list[tuple[int, Node]]:
        """(labels, root of its paths) of each node with rules on the host's walk."""
        found = self.known.get(host)
        if found is None:
            if len(self.known) >= HOSTS:
                self.known = {}
            found, node = [], self.root
            for depth, label in enumerate(reversed(host.split(".")), 1):
                node = node.below.get(label)
                if node is None:
                    break
                if node.paths is not None:
                    found.append((depth, node.paths))
            self.known[host] = found
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, won = (0, 0, 0), None
        for labels, node in self.hosts(host):
            at, depth = 0, 0
            while node is not None:
                # The path starts with the rule's if what is left of it starts with the rule's rest.
                for rest, rule in node.rests.items():
                    rank = (labels + depth, labels, len(rest))
                    if rank > best and path.startswith(rest, at):
                        best, won = rank, rule
                slash = path.find("/", at)
                if slash < 0:
                    break
                node, at, depth = node.below.get(path[at:slash]), slash + 1, depth + 1
        return won


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(rules)  # TRIE_CHARS at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = pa.array([x and x[0] for x in found], pa.string())
            verdict = pa.array([x[1] if x else default for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join of distinct (host, path): host suffixes and path prefixes of a URL meet the rules' own."""
    cut = F.split("path", "/", -1)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is the larger
    keyed = rules.select(
        F.col("host").alias("suffix"), F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), "/").alias("prefix"), F.size(cut).alias("segments"),
        F.get(cut, F.size(cut) - 1).alias("rest"), F.concat("host", "path").alias("rule"), "verdict",
    )
    # No URL needs more labels or segments than the longest rule has.
    most = rules.agg(F.max(F.size(F.split("host", "\\.", -1))), F.max(F.size(cut))).first()
    places = pages.select("host", "path").distinct()
    labels = F.split("host", "\\.", -1)
    spread = places.select("host", "path", labels.alias("labels"), cut.alias("cut")).select(
        "host", "path", "cut", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most[0])))).alias("n_labels"), "labels"
    )
    spread = spread.select(
        "host", "path", "cut", "n_labels", F.array_join(F.slice("labels", F.size("labels") - F.col("n_labels") + 1, F.col("n_labels")), ".").alias("suffix"),
        F.explode(F.sequence(F.lit(1), F.least(F.size("cut"), F.lit(most[1])))).alias("segments"),
    )
    spread = spread.select(
        "host", "path", "n_labels", "suffix", "segments", F.array_join(F.slice("cut", F.lit(1), F.col("segments") - 1), "/").alias("prefix"),
        F.get("cut", F.col("segments") - 1).alias("own"), F.array_join(F.slice("cut", F.col("segments"), F.size("cut")), "/").alias("left"),
    )
    met = spread.join(keyed, ["suffix", "prefix", "segments"]).filter(F.startswith("left", "rest"))
    rank = F.struct((F.col("n_labels") + F.col("segments")).alias("a"), F.col("n_labels").alias("b"), F.length("rest").alias("c"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
    joined = pages.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "won.rule", F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", trie_chars: int = TRIE_CHARS
) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that won, or NULL) and verdict of every row.

    `rules` are (host, path, verdict) rows, as a list or a table; the path is what a URL's path must start
    with, so '/' stands for every path but the empty one and '' for all. A rule fits its host and its
    subdomains. The rule of most labels and segments wins, then the one of more labels, then of the
    longer path; of equal rules with both verdicts block wins. Rows without a rule get `default`.

    A NULL URL, or one without `://`, has an empty host and path, which no rule fits. Rules with a NULL, with an empty
    host or with another verdict are refused. Repeated rows give repeated rows; other columns play no
    part; an empty table gives no rows, an empty list of rules the default everywhere. Nothing is
    shuffled while the trie is broadcast.
    """
    spark = ready(pages.sparkSession)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULE)
    listed = listed.select("host", "path", "verdict")
    odd = F.col("host").isNull() | (F.col("host") == "") | F.col("path").isNull() | F.col("verdict").isNull() | ~F.col("verdict").isin(ALLOW, BLOCK)
    chars, refused = listed.agg(F.sum(F.length("host") + F.length("path")), F.count_if(odd)).first()
    if refused:
        raise ValueError(f"{refused} rules lack a host, a path or a verdict of {ALLOW} or {BLOCK}")
    if chars is not None and chars > trie_chars:
        return _by_join(rows, listed, default)
    return _by_trie(rows, [tuple(r) for r in listed.collect()], default)
