"""URL filters: given rules, then a path-template tree per host.

Every host's paths form a tree of segments. Segments that are numbers, digests or dates in form become typed wildcards;
below a node with many children, those that each hold little become wildcards too, unless the labelled purity of a child,
or of a path below it, differs from that of its siblings. Templates whose labelled purity doesn't differ from that of
their siblings are merged into one branch, and so are, level by level up to the host, the merged branches. The bad share of a branch is smoothed by that of
the host, and that by the overall share; branches above the threshold are rejected.

Rows are counted by path first, so a host with a third of all rows is pre-aggregated before any shuffle. The tree of a host whose
paths have at most SMALL segments in all is built and merged in one task (url_tree.py), in time that grows with its nodes, also
where paths are hundreds of segments deep. Larger hosts go level by level, as grouped aggregations that touch only the rows that
reach the level. Both give the same templates and branches.

Defined results: a null url or one without :// has empty host and path, matches no rule and is judged as its template;
labels are counted once per row and rows without label count for the tree's form only; repeated rows are judged alike.
Empty tables give no rows. Paths are taken to their full depth, trailing empty segments don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .url_tree import grown_tree

#: Segments of a host's paths up to which its tree is built in one task, some 150 MB.
SMALL = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all subdomains and all paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """name or verdict of the longest rule that fits, else null; rules are few and given, so they are one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, what)).otherwise(out)
    return out


def typed(segment: Column) -> Column:
    """The form of a segment: a wildcard for numbers, digests and dates, else itself."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"([A-Za-z]{1,5})$", 1)))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"^[0-9a-fA-F]{8,}$") | segment.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$"), F.lit("{hex}"))
        .when(segment.rlike(r"[0-9]{3,}"), F.regexp_replace(segment, r"[0-9]{3,}", "{n}"))
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    """Typed segments of the whole path."""
    return F.transform(F.split(F.rtrim(F.ltrim(path, F.lit("/")), F.lit("/")), "/"), typed)


def _differs(bad: Column, labelled: Column, all_bad: Column, all_labelled: Column, z: float) -> Column:
    """Whether the labelled purity of a part differs from that of the rest of the whole, by z standard errors."""
    rest_n, rest_bad, pooled = all_labelled - labelled, all_bad - bad, F.try_divide(all_bad, all_labelled)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), rest_n)))
    return F.coalesce(F.abs(F.try_divide(bad, labelled) - F.try_divide(rest_bad, rest_n)) > z * error, F.lit(False))


def _depth(tree: DataFrame, rank: int) -> int:
    """The greatest depth that at least `rank` of one host's rows have or exceed; no node at or below it has more children."""
    depths = tree.groupBy("host", F.size("t").alias("depth")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("host").orderBy(F.desc("depth")))
    return depths.withColumn("rows", upto).where(F.col("rows") >= rank).agg(F.max("depth")).first()[0] or 0


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]


def counted(urls: DataFrame) -> DataFrame:
    """host, segs (typed segments), n, labelled, bad of each path. urls: host, path, bad (null: no label)."""
    rows = urls.select("host", "bad", _segments(F.col("path")).alias("segs"))
    tree = rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    return materialise(tree, "url-tree")


def templates(tree: DataFrame, most_children: int = 32, heavy: float = 0.05, z: float = 2.0) -> DataFrame:
    """Generalised paths, level by level: host, segs, t (segments of the template), n, labelled, bad of counted() paths."""
    tree = tree.select("host", "segs", "n", "labelled", "bad", F.col("segs").alias("t"))
    finished: list[DataFrame] = []
    for i in range(_depth(tree, most_children + 1)):
        at = tree.where(F.size("t") > i).withColumn("up", F.slice("t", 1, i)).withColumn("child", F.col("t")[i])
        children = at.groupBy("host", "up", "child").agg(*_sums())
        node = children.groupBy("host", "up").agg(F.count(F.lit(1)).alias("kinds"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad"))).where(F.col("kinds") > most_children)
        node = materialise(node, "url-nodes")
        if node.isEmpty():
            continue
        light = children.join(node, ["host", "up"]).where(F.col("n") < heavy * F.col("all_n"))
        light = materialise(light.select("host", "up", "child"), "url-light")
        # a child is kept where it, or what is below it down to some depth, differs from the same of all light siblings
        below = at.join(light, ["host", "up", "child"])
        below = below.select("host", "up", "child", "labelled", "bad", F.explode(F.sequence(F.lit(0), F.size("t") - i - 1)).alias("down"), F.slice("t", i + 2, F.size("t")).alias("rest")).where("labelled > 0")
        below = below.groupBy("host", "up", "child", F.slice("rest", F.lit(1), F.col("down")).alias("rest")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        like = below.groupBy("host", "up", "rest").agg(F.sum("labelled").alias("l_all"), F.sum("bad").alias("b_all"))
        kept = below.join(like, ["host", "up", "rest"]).where(_differs(F.col("bad"), F.col("labelled"), F.col("b_all"), F.col("l_all"), z)).select("host", "up", "child").distinct()
        wide = light.join(kept, ["host", "up", "child"], "left_anti").withColumn("wild", F.lit(True))
        generalised = F.when(F.col("wild"), F.concat("up", F.array(F.lit("*")), F.slice("t", i + 2, F.greatest(F.size("t"), F.lit(1))))).otherwise(F.col("t"))
        finished.append(tree.where(F.size("t") <= i))
        tree = materialise(at.join(wide, ["host", "up", "child"], "left").select("host", "segs", "n", "labelled", "bad", generalised.alias("t")), "url-tree")
    for part in finished:
        tree = tree.unionByName(part)
    return tree


def _named(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def branches(tree: DataFrame, z: float = 2.0) -> DataFrame:
    """host, t, b (the branch's segments), labelled, bad for each template, merged level by level from the deepest on.

    What is merged below a segment is a branch b = (..., segment, *) that has the segment's siblings for its own, and the
    template that ends with the segment too. level: the number of segments that siblings have.
    """
    leaves = materialise(tree.groupBy("host", "t").agg(*_sums()).select("host", "t", "labelled", "bad"), "url-leaves")
    deepest = max(1, _depth(leaves, 2))
    # a path deeper than all others of its host has no siblings there
    under = lambda path, n: F.concat(F.slice(path, 1, n) if n else F.array().cast("array<string>"), F.array(F.lit("*")))
    start = F.when(F.size("t") > deepest, under("t", deepest)).otherwise(F.col("t"))
    leaves = leaves.select("host", "t", start.alias("b"), F.least(F.size("t"), F.lit(deepest)).alias("level"), "labelled", "bad")
    out, moved = [], leaves.where("false")
    for i in range(deepest, 0, -1):
        here = leaves.where(F.col("level") == i).unionByName(moved)
        parts = here.groupBy("host", "b").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("x")).withColumn("up", F.slice("b", 1, i - 1))
        wholes = parts.groupBy("host", "up").agg(F.sum("l").alias("l_all"), F.sum("x").alias("x_all"))
        apart = parts.join(wholes, ["host", "up"]).where(_differs(F.col("x"), F.col("l"), F.col("x_all"), F.col("l_all"), z)).select("host", "b", F.lit(True).alias("apart"))
        told = materialise(here.join(apart, ["host", "b"], "left"), "url-branches")
        out.append(told.where("apart").drop("apart"))
        moved = told.where("apart is null").drop("apart").withColumn("b", under("b", i - 1)).withColumn("level", F.lit(i - 1))
    for part in out:
        moved = moved.unionByName(part)
    return moved.drop("level")


def branched(tree: DataFrame, most_children: int = 32, heavy: float = 0.05, z: float = 2.0, small: int = SMALL) -> DataFrame:
    """host, segs, template, branch, labelled, bad of counted() paths."""
    sizes = tree.groupBy("host").agg(F.sum(F.size("segs")).alias("segments"))
    large = materialise(sizes.where(F.col("segments") > small).select("host"), "url-hosts")
    few = tree.join(large, "host", "left_anti")
    kind = "host string, segs array<string>, template string, branch string, labelled long, bad long"
    found = few.groupBy("host").applyInPandas(lambda rows: grown_tree(rows, most_children, heavy, z), kind)
    if large.isEmpty():
        return found
    paths = templates(tree.join(large, "host", "left_semi"), most_children, heavy, z)
    named = branches(paths, z).select("host", "t", _named(F.col("t")).alias("template"), _named(F.col("b")).alias("branch"))
    return found.unionByName(paths.join(named, ["host", "t"]).select("host", "segs", "template", "branch", "labelled", "bad"))


def judged(both: DataFrame, smoothing: float = 20.0, most_bad: float = 0.5) -> DataFrame:
    """host, segs, template, branch, bad_share, rejected of branched() paths, which are written."""
    merged = both.groupBy("host", "branch").agg(F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"))
    hosts = both.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    whole = hosts.agg(F.try_divide(F.sum("h_bad"), F.sum("h_labelled")).alias("overall"))
    overall = F.coalesce("overall", F.lit(0.0))
    host_share = (F.col("h_bad") + smoothing * overall) / (F.col("h_labelled") + smoothing)
    share = (F.col("b_bad") + smoothing * host_share) / (F.col("b_labelled") + smoothing)
    shares = merged.join(hosts, "host").join(F.broadcast(whole)).select("host", "branch", share.alias("bad_share"))
    return both.select("host", "segs", "template", "branch").join(shares, ["host", "branch"]).withColumn("rejected", F.col("bad_share") > most_bad)


def filter_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, smoothing: float = 20.0, most_bad: float = 0.5, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch, bad_share for each row of pages.

    labels: page_id, bad (boolean), at most one row for each page_id that counts. how: parameters of branched().
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = rows.withColumn("bad", F.lit(None).cast("boolean"))
    if labels is not None:
        known = rows.join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    both = materialise(branched(counted(known.select("host", "path", "bad")), **how), "url-paths")
    verdicts = judged(both, smoothing, most_bad)
    keyed = rows.withColumn("segs", _segments(F.col("path")))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(rules, host, path, "verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return keyed.join(verdicts, ["host", "segs"]).select("page_id", "host", "path", rule_of(rules, host, path, "name").alias("rule"), verdict.alias("verdict"), "template", "branch", "bad_share")
