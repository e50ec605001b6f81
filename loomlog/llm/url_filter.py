"""URL filter: rules for hosts and paths, and trust that flows along links for pages that no rule fits.

Host edges are the absolute links of pages, from the linking to the linked host, and weak edges between a
host and its parent domain. Personalised PageRank from the hosts of allowed pages gives trust; the same
over reversed edges from the hosts of blocked pages gives distrust. A host is blocked when its distrust
is above ``THRESHOLD`` times its trust. Rank at hosts without links of their own goes back to the seeds, so trust and distrust
add up to their seeds' shares. Rounds go on until every host that links lead to is reached and no
rank moves by more than ``TOLERANCE`` of itself. Everything is DataFrame operations; trust and distrust share
their rounds, and ranks are kept in the shared folder every few of them.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, since
nothing speaks against it; null html has no links; a null page_id is kept; repeated rows give repeated rows
and count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEEP_EVERY = 8
#: Edges for each task of a round, where there are more than the cores take.
EDGES_EACH = 250_000
#: Ranks are final when none moved by more than this share of itself in ``KEEP_EVERY`` rounds.
TOLERANCE = 1e-4
DAMPING = 0.85
THRESHOLD = 2.0
PARENT_WEIGHT = 0.1

#: Second-level labels under which the public registers domains in countries; hosts below share no owner.
PUBLIC_SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gov", "gv", "id", "ltd", "mil", "ne", "net", "nom", "or", "org", "sch")


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool


RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and whether it allows; of equally long ones a blocking rule wins."""
    text = allow = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), not r.allow)):  # later ones win
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, allow = F.when(fits, F.lit(r.host + r.path)).otherwise(text), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text.cast("string"), allow.cast("boolean")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) over hosts, from ``pages`` (host, html)."""
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    linked = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.filter("host <> ''").select("host").distinct()
    up = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).filter("instr(src, '.') > 0 and instr(dst, '.') > 0")
    up = up.filter(~F.col("dst").rlike(rf"^({'|'.join(PUBLIC_SECOND_LEVELS)})\.[a-z]{{2}}$"))
    up = up.withColumn("w", F.lit(PARENT_WEIGHT))
    both = linked.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def page_rank(edges: DataFrame, seeds: DataFrame, *, rounds: int | None = None, damping: float = DAMPING, total: float | None = None, part: Column | None = None) -> DataFrame:
    """(host, rank) from ``edges`` (src, dst, w) and ``seeds`` (host, weight); hosts that are not reached have no row.

    Ranks of each ``part`` (a short column over host that no edge leaves; by default there is one) add up to its seeds' share of
    ``total``, by default all of it. Without ``rounds`` they converge to ``TOLERANCE``.

    The rounds let rank at hosts without out-links go. Were it sent back to the seeds each time, r = d M r + c s with a number c
    for start s, so r is the result of these rounds times a number: ranks are scaled once, at the end.
    """
    part = F.lit("") if part is None else part
    total = seeds.agg(F.sum("weight")).first()[0] if total is None else total
    out = edges.groupBy("src").agg(F.sum("w").alias("all_w"))
    steps = common.checkpointed(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all_w")).alias("share")))
    # a round's tasks go by the size of the graph: each writes files for its shuffle, and rounds are many
    tasks = max(seeds.sparkSession.sparkContext.defaultParallelism, -(-steps.count() // EDGES_EACH))
    steps = steps.coalesce(tasks)
    start = seeds.select("host", (F.col("weight") / F.lit(float(total or 1))).alias("rank")).coalesce(tasks)
    rank = kept = start
    for k in itertools.count() if rounds is None else range(rounds):
        moved = rank.withColumnRenamed("host", "src").join(steps, "src").select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.unionByName(start.select("host", (F.col("rank") * (1 - damping)).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
        if (k + 1) % KEEP_EVERY == 0:
            rank = common.checkpointed(rank)
            if rounds is None:
                both = rank.join(kept.withColumnRenamed("rank", "was"), "host", "left")
                moved = both.agg(F.max(F.when(F.col("rank") > 0, F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) / F.col("rank")))).first()[0]
                if (moved or 0.0) <= TOLERANCE:
                    break
                kept = rank
    rank = rank if rounds is None else common.checkpointed(rank)
    held = {r.part: r.rank for r in rank.groupBy(part.alias("part")).agg(F.sum("rank").alias("rank")).collect()}
    scale = {r.part: r.rank / held[r.part] for r in start.groupBy(part.alias("part")).agg(F.sum("rank").alias("rank")).collect() if held.get(r.part)}
    factor = F.lit(1.0)
    for name, by in sorted(scale.items()):
        factor = F.when(part == name, F.lit(by)).otherwise(factor)
    return rank.withColumn("rank", F.col("rank") * factor)


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    url = F.col("url").cast("string")
    rule, allow = fitting(F.col("host"), F.col("path"), rules)
    told = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    told = told.select("page_id", "host", "path", "html", rule.alias("rule"), allow.alias("allow"))
    edges = common.checkpointed(host_edges(told))
    seeds = common.checkpointed(told.filter("allow is not null and host <> ''").groupBy("host", "allow").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0  # one scale for trust and distrust
    # one graph of both: "+" before hosts of trust along the links, "-" before hosts of distrust against them
    named = lambda sign, name: F.concat(F.lit(sign), F.col(name))
    signed = edges.select(named("+", "src").alias("src"), named("+", "dst").alias("dst"), "w").unionByName(edges.select(named("-", "dst").alias("src"), named("-", "src").alias("dst"), "w"))
    ranks = page_rank(signed, seeds.select(F.concat(F.when(F.col("allow"), "+").otherwise("-"), "host").alias("host"), "weight"), total=total, part=F.substring("host", 1, 1))
    of = lambda sign: F.sum(F.when(F.col("host").startswith(sign), F.col("rank")))
    scores = ranks.groupBy(F.substring("host", 2, 1 << 30).alias("at")).agg(of("+").alias("trust"), of("-").alias("distrust")).withColumnRenamed("at", "host")
    found = told.drop("html").join(scores, "host", "left")
    good, bad = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.when(F.coalesce("allow", bad <= good * threshold), "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), good.alias("trust"), bad.alias("distrust"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
