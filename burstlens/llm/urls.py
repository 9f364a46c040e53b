"""URL filter rules, indexed by their rarest literal token.

A rule is written as a pattern over host and path: ``||`` anchors at the host or one of its subdomains, ``|`` at the start,
``*`` is any text, ``^`` is a separator (any character that is not a letter, digit, ``_``, ``-``, ``.`` or ``%``) or an end.
Each rule has literal tokens, the runs of lower-case letters and digits that any fitting url holds as whole tokens. The
rule is filed under the one that the fewest urls of the corpus hold; a url fetches the rules filed under its tokens, and only
those are matched by regular expression.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule with a token; repeated urls get
the same verdict on every row; when several rules of one kind fit, the longest written wins, then the smallest text; an empty
table gives no rows; clashing column names do not matter, only the id and url columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Up to so many rules are broadcast; beyond, the planner joins by shuffle.
BROADCAST_RULES = 200_000
SEPARATOR = r"(?:[^0-9A-Za-z_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    """``kind`` 0 is decisive, kind 1 is asked only where no rule of kind 0 fits."""

    text: str
    action: str
    kind: int = 0

    @property
    def regex(self) -> str:
        body = self.text
        head = ""
        if body.startswith("||"):
            head, body = r"^(?:[^/]*\.)?", body[2:]
        elif body.startswith("|"):
            head, body = "^", body[1:]
        tail = ""
        if body.endswith("|"):
            tail, body = "$", body[:-1]
        return head + "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Runs that stand as whole tokens in every fitting url: bounded on both sides by an anchor or a separator."""
        starts_bound = self.text.startswith("|")
        ends_bound = self.text.endswith("|")
        body = self.text.strip("|")
        found = []
        for m in re.finditer("[0-9a-z]+", body.lower()):
            left = starts_bound if m.start() == 0 else body[m.start() - 1] != "*"
            right = ends_bound if m.end() == len(body) else body[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return found


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def subjects(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct (host, path): what rules see of the urls. Combined before the shuffle."""
    host, path = host_path(F.col(f"`{url_col}`"))
    return pages.select(host.alias("host"), path.alias("path")).distinct()


def _tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url; the empty token fetches the rules without literals."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(F.concat(host, path)), "[^0-9a-z]+")))


def index_rules(spark: SparkSession, rules: list[Rule], seen: DataFrame) -> DataFrame:
    """Rules with the token they are filed under: the one that the fewest distinct urls hold, over all of them."""
    rows = [(r.text, r.action, r.kind, r.regex, t) for r in rules for t in (r.tokens or [""])]
    wide = spark.createDataFrame(rows, "rule string, action string, kind int, regex string, token string")
    names = wide.select("token").distinct()
    if len(rows) <= BROADCAST_RULES:
        names = F.broadcast(names)
    held = seen.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(names, "token").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    best = F.min_by("token", F.struct(F.coalesce("held", F.lit(0)), "token")).alias("token")
    return wide.join(held, "token", "left").groupBy("rule", "action", "kind", "regex").agg(best)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, host, path, ``rule`` (the fitting rule of kind 0) and ``verdict``.

    A rule of kind 0 decides; else the longest fitting rule of kind 1; else ``default``. Rules are matched once per distinct
    (host, path); the matches, a fraction of the urls, are joined back, and the adaptive planner splits a busy url there.
    """
    seen = subjects(pages, url_col)
    index = index_rules(pages.sparkSession, rules, seen)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    asked = seen.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    fits = asked.join(index, "token").where(F.expr("concat(host, path) rlike regex"))
    rank = F.struct((-F.length("rule")).alias("longest"), F.col("rule"))
    first = lambda what, kind: F.min_by(what, F.when(F.col("kind") == kind, rank))
    # min_by leaves out null orderings, so each picks among the rules of its kind
    found = fits.groupBy("host", "path").agg(first("rule", 0).alias("rule"), first("action", 0).alias("decisive"), first("action", 1).alias("method"))
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    return rows.join(found, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("decisive", "method", F.lit(default)).alias("verdict"))
