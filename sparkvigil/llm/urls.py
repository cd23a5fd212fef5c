"""URL filtering: allow and block rules, and a tree of path templates for the rest. DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host and path): a rule fits the host and its subdomains where the path starts as the rule's does.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DISTINCT, SHARE = 8, 0.1
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are part of the plan, so at most MOST_RULES."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _masked(path: Column) -> Column:
    """The path's segments with each run of characters around a digit, up to a dot, as *."""
    return F.regexp_replace(path, r"[^/.]*[0-9][^/.]*", "*")


def templates(counts: DataFrame) -> DataFrame:
    """``counts`` (host, masked, n, ...), one row a masked path, with ``segments``: its template in the host's tree.

    Level by level, to the last segment, the children of a node become `*` if they are variable: at least DISTINCT,
    with at most half as many different paths below them as there are children. Children with a share of SHARE of
    the node's URLs keep their name. How many rows a path has changes nothing but that share.

    A node with fewer than DISTINCT paths below it has no variable child at any depth, so these paths are finished at once; levels
    go on while other nodes are left, each level written once.
    """
    rows = counts.withColumn("left", F.slice(F.split("masked", "/"), 2, 1 << 30)).withColumn("segments", F.expr("cast(array() as array<string>)"))
    done = []
    while True:
        node = W.partitionBy("host", "segments")
        # one row a masked path: rows of a node are its different paths
        rows = cut(rows.withColumn("paths", F.count("*").over(node)), "level")
        ends = (F.size("left") == 0) | (F.col("paths") < DISTINCT)
        done.append(rows.where(ends).withColumn("segments", F.concat("segments", "left")).drop("left", "paths"))
        rows = rows.where(~ends)
        if rows.isEmpty():
            break
        here = F.get("left", F.lit(0))
        rest = F.xxhash64(F.array_join(F.slice("left", 2, 1 << 30), "/"))
        each = rows.groupBy("host", "segments", here.alias("child")).agg(F.sum("n").alias("n"))
        below = rows.groupBy("host", "segments").agg(F.count_distinct(here).alias("children"), F.count_distinct(rest).alias("rests"), F.sum("n").alias("total"))
        variable = below.where((F.col("children") >= DISTINCT) & (2 * F.col("rests") <= F.col("children")))
        wild = each.join(variable, ["host", "segments"]).where(F.col("n") < SHARE * F.col("total")).select("host", "segments", "child", F.lit(True).alias("wild"))
        met = rows.withColumn("child", here).join(wild, ["host", "segments", "child"], "left")
        named = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("child"))
        rows = met.withColumn("segments", F.concat("segments", F.array(named))).withColumn("left", F.slice("left", 2, 1 << 30)).select([c for c in rows.columns if c != "paths"])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def branches(placed: DataFrame, rate: float, purity: float = 0.8, least: int = 5, weight: float = 4.0) -> DataFrame:
    """(host, masked, template, block_share, rejected) of each row of ``placed`` (host, masked, segments, known, blocked, n).

    From the root down, the children of a branch that have the same commonest child of their own (leaves: none) are
    compared: those with labels, by rising block share, are one branch while neighbours don't differ at the 5% level, and
    those without labels join it where there is only one, else they are a branch of their own. Merged branches pool what lies
    below them. A branch's share is that of its labelled URLs, with ``weight`` more at its parent's share; the root's at ``rate``.
    The deepest branch below the root with at least ``least`` labelled URLs decides: it rejects from a share of ``purity`` on.

    A path that is alone in its branch meets no other below it: its levels to the last are taken in one step, each drawing the share
    towards its own, to (share - own) (weight / (known + weight)) ^ levels from it. Levels go on while branches of several paths are left.
    """
    root = placed.groupBy("host").agg(((F.sum("blocked") + weight * rate) / (F.sum("known") + weight)).alias("share"))
    none = F.lit(None).cast("double")
    rows = placed.join(root, "host").select("host", "masked", "segments", "known", "blocked", "n", F.lit("").alias("template"), "share", none.alias("block_share"), F.lit(False).alias("rejected"))
    done, level = [], 0
    while True:
        rows = cut(rows.withColumn("together", F.count("*").over(W.partitionBy("host", "template"))), "down")
        left = F.size("segments") - level
        own = F.when(F.col("known") > 0, F.col("blocked") / F.greatest(F.col("known"), F.lit(1))).otherwise(F.col("share"))
        final = own + (F.col("share") - own) * F.pow(F.lit(weight) / (F.col("known") + weight), left)
        decides = (left > 0) & (F.col("known") >= least)
        rest = F.slice("segments", level + 1, 1 << 30)
        template = F.when(left > 0, F.concat_ws("/", "template", F.array_join(rest, "/"))).otherwise(F.col("template"))
        ends = (left <= 0) | (F.col("together") == 1)
        done.append(rows.where(ends).select("host", "masked", template.alias("template"), F.when(decides, final).otherwise(F.col("block_share")).alias("block_share"), F.when(decides, final >= purity).otherwise(F.col("rejected")).alias("rejected")))
        rows = rows.where(~ends).drop("together")
        if rows.isEmpty():
            break
        level += 1
        here, after = F.get("segments", F.lit(level - 1)), F.get("segments", F.lit(level))
        each = rows.groupBy("host", "template", "share", here.alias("child"), after.alias("after")).agg(*[F.sum(c).alias(c) for c in ("known", "blocked", "n")])
        nodes = each.groupBy("host", "template", "share", "child").agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked"), F.coalesce(F.max_by("after", F.when(F.col("after").isNotNull(), F.struct("n", "after"))), F.lit("/")).alias("kind"))
        own = (F.col("blocked") + weight * F.col("share")) / (F.col("known") + weight)
        nodes = nodes.withColumn("own", own).withColumn("var", F.greatest(own * (1 - own), F.lit(1e-9)) / (F.col("known") + weight)).withColumn("labelled", F.col("known") > 0)
        alike = W.partitionBy("host", "template", "kind", "labelled").orderBy("own", "child")
        apart = F.abs(F.col("own") - F.lag("own").over(alike)) > 1.96 * F.sqrt(F.col("var") + F.lag("var").over(alike))
        nodes = nodes.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
        nodes = nodes.withColumn("branch", F.sum("apart").over(alike.rowsBetween(W.unboundedPreceding, W.currentRow)))
        # unlabelled nodes look at their labelled siblings' branches
        siblings = W.partitionBy("host", "template", "kind")
        joined = nodes.withColumn("parts", F.max(F.when(F.col("labelled"), F.col("branch"))).over(siblings))
        joined = joined.withColumn("branch", F.when(F.col("labelled"), F.col("branch")).when(F.col("parts") == 0, 0).otherwise(-1))
        pool = W.partitionBy("host", "template", "kind", "branch")
        named = joined.select("host", "template", "child", F.sum("known").over(pool).alias("seen"), F.sum("blocked").over(pool).alias("bad"), F.min("child").over(pool).alias("first"), "share")
        named = named.select("host", "template", "child", "seen", ((F.col("bad") + weight * F.col("share")) / (F.col("seen") + weight)).alias("next_share"), F.concat_ws("/", "template", "first").alias("below"))
        met = rows.withColumn("child", here).join(named, ["host", "template", "child"], "left")
        decides = F.col("seen") >= least
        rows = met.select(
            "host", "masked", "segments", "known", "blocked", "n", F.coalesce("below", "template").alias("template"), F.coalesce("next_share", "share").alias("share"),
            F.when(decides, F.col("next_share")).otherwise(F.col("block_share")).alias("block_share"), F.when(decides, F.col("next_share") >= purity).otherwise(F.col("rejected")).alias("rejected"),
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge(pages: DataFrame, rules=RULES, purity: float = 0.8, least: int = 5, weight: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and block_share of every row of ``pages``.

    The rule's verdict holds where one fits. URLs with a rule are also the labelled ones, from which ``branches`` of the
    host's template tree are judged: URLs without a rule get block where theirs rejects; all else allow. block_share is
    that of the branch that decides (null: none has enough labels). Null urls and urls without :// have empty host and path and
    are allowed; rows that repeat count each. Template names hold the least child of each merged branch.
    """
    host, path = host_of(F.coalesce("url", F.lit(""))), path_of(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _masked(F.col("path")).alias("masked"))
    blocked = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    counts = cut(rows.groupBy("host", "masked").agg(F.count("*").alias("n"), F.count(blocked).alias("known"), F.coalesce(F.sum(blocked), F.lit(0)).alias("blocked")), "paths")
    total = counts.agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked")).first()
    rate = (total.blocked or 0) / total.known if total.known else 0.5
    judged = branches(templates(counts), rate, purity, least, weight)
    named = judged.select(F.col("host").alias("_host"), F.col("masked").alias("_masked"), "template", "block_share", "rejected")
    met = rows.join(named, (F.col("host") == F.col("_host")) & (F.col("masked") == F.col("_masked")), "left")
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "block_share")


def z(a: tuple[int, int], b: tuple[int, int], rate: float, weight: float = 4.0) -> float:
    """The distance of two (blocked, known) branches in standard errors, as ``branches`` takes it."""
    shares = [(x + weight * rate) / (n + weight) for x, n in (a, b)]
    var = [max(s * (1 - s), 1e-9) / (n + weight) for s, (_, n) in zip(shares, (a, b), strict=True)]
    return abs(shares[0] - shares[1]) / math.sqrt(sum(var))
