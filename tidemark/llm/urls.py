"""URL filters from a path-template tree per host, in DataFrame functions only.

Level by level, the segments of a host's paths become children of a tree node. A node with
many rare children is variable: these turn into a wildcard. Other branches keep their names
unless labels on both sides show them to be alike: only then they are merged into the wildcard.
A template is rejected if the share of bad labels in it, smoothed towards the share in all
pages, is high. Each label counts in one template only, so a template without labels has the
share of all pages, whatever its siblings are.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized

WILD = "*"
#: Stands for the rest of a path under a node without labels.
REST = "**"
#: A child is rare with fewer pages than this, or a smaller share of its node's; with so many rare children a node is variable.
LEAST, SHARE, MANY = 3, 0.02, 10
#: Labels that a branch and its siblings must have before they can be found alike.
EVIDENCE = 5
#: Two-sided 5 % point of the normal distribution: branches below it count as alike.
SIMILAR = 1.96
#: Pseudo-pages of the whole table in a template's purity; purity at which a template is rejected.
WEIGHT, REJECT = 4.0, 0.8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule (verdict,
    host + path) fits its host and all subdomains if the path starts with its path."""
    rule = verdict = F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, start = name.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with every run of digits as #; empty segments are dropped."""
    return F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda s: s != "")


def template_tree(pages: DataFrame) -> DataFrame:
    """Templates of pages with columns host, parts (segments), bad (boolean; null: no label).

    Result, one row per distinct (host, parts): template (array), purity. Pages are counted
    by (host, parts) before anything else, so a host with a third of all pages is a few
    partial counts; nodes and branches are sums of those. A path leaves the loop when its node
    has no labels or no other path: there are as many rounds as segments that labelled paths share.
    """
    shapes = materialized(pages.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("rejected")))
    total = shapes.agg(F.sum("labelled").alias("l"), F.sum("rejected").alias("r")).first()
    prior = (total.r or 0) / total.l if total.l else 0.0
    done, open_, depth = [], shapes.withColumn("template", F.array().cast("array<string>")), 0
    while True:
        grown = materialized(_grown(open_, depth))
        done.append(grown.where("done"))
        open_, depth = grown.where("NOT done").drop("done"), depth + 1
        if open_.isEmpty():
            break
    tree = done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    tree = tree.drop("done")
    own = tree.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
        F.sum("labelled").alias("_l"), F.sum("rejected").alias("_r"))
    purity = (F.col("_r") + WEIGHT * prior) / (F.col("_l") + WEIGHT)
    return tree.join(own, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select(
        *shapes.columns, "template", purity.alias("purity"))


def _grown(tree: DataFrame, depth: int) -> DataFrame:
    """The open paths with one more segment of their templates, or done."""
    part = F.get("parts", F.lit(depth))
    children = tree.groupBy("host", "template", part.alias("part")).agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "rejected")], F.count(F.lit(1)).alias("shapes"))
    node = [F.col("host").alias("_h"), F.col("template").alias("_t")]
    sums = children.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "rejected", "shapes")])
    named = children.join(sums, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    rare = (F.col("n") < LEAST) | (F.col("n") < SHARE * F.col("all_n"))
    crowd = named.groupBy("_h", "_t").agg(F.count_if(rare & F.col("part").isNotNull()).alias("_rare")).select(
        F.col("_h").alias("_h2"), F.col("_t").alias("_t2"), "_rare")
    named = named.join(crowd, (F.col("_h") == F.col("_h2")) & (F.col("_t") == F.col("_t2")))
    # Two-proportion test of a branch against its siblings.
    n1, n2 = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    pooled = F.col("all_rejected") / F.nullif("all_labelled", F.lit(0))
    gap = F.abs(F.col("rejected") / F.nullif(n1, F.lit(0)) - (F.col("all_rejected") - F.col("rejected")) / F.nullif(n2, F.lit(0)))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    alike = (n1 >= EVIDENCE) & (n2 >= EVIDENCE) & ((gap == 0) | (gap < SIMILAR * spread))
    wild = (rare & (F.col("_rare") >= MANY)) | F.coalesce(alike, F.lit(False))
    branch = named.select("_h", "_t", F.col("part").alias("_p"), "all_labelled", "all_shapes", F.when(wild, F.lit(WILD)).otherwise(F.col("part")).alias("_s"))
    hit = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & part.eqNullSafe(F.col("_p"))
    left = F.size("parts") - depth
    rest = F.slice("parts", depth + 1, F.greatest(left, F.lit(1)))
    template = (F.when(left <= 0, F.col("template"))
                .when(F.col("all_labelled") == 0, F.concat("template", F.array(F.lit(REST))))
                .when(F.col("all_shapes") == 1, F.concat("template", rest))
                .otherwise(F.concat("template", F.array("_s"))))
    over = (left <= 0) | (F.col("all_labelled") == 0) | (F.col("all_shapes") == 1)
    return tree.join(branch, hit).select(*[c for c in tree.columns if c != "template"], template.alias("template"), over.alias("done"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url",
               label: str | None = None) -> DataFrame:
    """Host, path, fitting rule and verdict of every url; template and purity beside them.

    A rule's verdict stands; otherwise a page is blocked if its template's purity reaches
    ``REJECT``. Labels (true: bad) come from the column ``label``, or from the rules' own
    verdicts where it is null or not given. Null urls and urls without :// have an empty host and
    path and form one template. Ids are not looked at: null and repeated ids stay rows.
    """
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    given = F.col(f"`{label}`").cast("boolean") if label else F.lit(None).cast("boolean")
    seen = pages.select(F.col(f"`{id}`"), host.alias("host"), path.alias("path"), given.alias("_given"))
    seen = seen.withColumns({"rule": rule, "_said": said, "parts": segments(F.col("path"))})
    seen = seen.withColumn("bad", F.coalesce("_given", F.when(F.col("_said").isNotNull(), F.col("_said") == "block")))
    tree = template_tree(seen.select("host", "parts", "bad")).select(
        F.col("host").alias("_h"), F.col("parts").alias("_p"), "template", "purity")
    out = seen.join(tree, (F.col("host") == F.col("_h")) & (F.col("parts") == F.col("_p")), "left")
    own = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id, "host", "path", "rule", F.coalesce("_said", own).alias("verdict"),
                      F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
