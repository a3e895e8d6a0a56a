"""URL filters: fixed rules, and a tree of path templates for each host.

Segments of a path that vary (numbers, digests, or a branch with many rare children) become wildcards. Then branches
that are statistically similar are merged. Within a host, from the leaves up: labelled siblings, if what stands below
them is distributed alike and their shares of blocked pages do not differ by more than chance. Between hosts: branches
of the same template, so that a host without labels for one goes with the hosts that have some. A template gets the
share of blocked among the labelled pages of what it is merged with, smoothed towards the share of its host and of all;
a lent one the mean of the hosts' shares, each counted once, so that no host outweighs the others. Templates that are
pure enough are rejected; one that nothing labelled is merged with never is. All DataFrame code.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no rule and is allowed;
repeated pages count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import cut

#: Verdict, host and path of each rule, as (verdict, "host/path").
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class TreeConfig:
    #: Segments beyond this depth are one branch.
    depth: int = 4
    #: A child is rare if it has less than this share of its parent; a branch with so many children gets a wildcard for them.
    rare: float = 0.02
    many: int = 20
    #: A branch is similar to its labelled siblings if so much of the two distributions of what stands below is common.
    similar: float = 0.5
    #: Labelled siblings within so many standard errors of their common share are merged.
    errors: float = 2.0
    #: Weight of the share of a host in that of its templates, and of the share of all in that of a host, in pages; and of
    #: the share of all in that of a template that other hosts lend, in hosts.
    prior: float = 4.0
    #: A template is lent by so many hosts at least.
    lenders: int = 3
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda g: F.coalesce(F.regexp_extract(url, pattern, g), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column, depth: int) -> Column:
    """Segments as an array of ``depth`` strings, empty beyond the end; numbers and digests are wildcards already."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    head, tail = F.slice(parts, 1, depth - 1), F.slice(parts, F.lit(depth), F.greatest(F.size(parts), F.lit(1)))
    every = F.concat(head, F.when(F.size(tail) > 0, F.array(F.array_join(tail, "/"))).otherwise(F.array()))

    def lexical(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d+(\.\w+)?$"), F.regexp_replace(s, r"^\d+", "{n}"))
            .when(s.rlike(r"^[0-9a-fA-F-]{16,}(\.\w+)?$"), F.regexp_replace(s, r"^[0-9a-fA-F-]+", "{h}"))
            .otherwise(s)
        )

    return F.transform(every, lexical)


def templates(paths: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """``paths`` (host, path, n, more) with ``template``: array of segments in which variable ones are wildcards.

    Works on distinct (host, path) with their counts. From the root down, a segment is a wildcard if its branch has
    many children and it is a rare one; branches are counted with the wildcards above them. Each level reads the one
    above it twice, so each ends in a checkpoint; else the plan would double from level to level.
    """
    c = config
    out = cut(paths.withColumn("template", _segments(F.col("path"), c.depth)))
    for d in range(c.depth):
        key = [F.col("host"), F.slice("template", 1, d).alias("above"), F.try_element_at("template", F.lit(d + 1)).alias("child")]
        children = out.where(F.size("template") > d).groupBy(*key).agg(F.sum("n").alias("own"))
        parents = children.groupBy("host", "above").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("kinds"))
        rare = children.join(parents, ["host", "above"]).where((F.col("kinds") >= c.many) & (F.col("own") < c.rare * F.col("all")) & ~F.col("child").startswith("{"))
        rare = rare.select("host", "above", "child", F.lit(True).alias("rare"))
        out = out.select("*", *key[1:]).join(rare, ["host", "above", "child"], "left")
        wild = F.concat(F.slice("template", 1, d), F.array(F.lit("*")), F.slice("template", d + 2, c.depth))
        out = out.withColumn("template", F.when(F.col("rare"), wild).otherwise(F.col("template"))).drop("above", "child", "rare")
        out = cut(out)
    return out


def merged(leaves: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """``leaves`` (host, template, labelled, blocked, n) with ``group``: the template, merged branches as ``~``.

    A branch is compared with all its labelled siblings together, so no pairs of branches are made.
    """
    c = config
    out = cut(leaves.withColumn("group", F.col("template")))
    for d in reversed(range(c.depth)):
        at = ["host", "above"]
        branch = out.where(F.size("template") > d).select("host", F.slice("template", 1, d).alias("above"), F.element_at("template", d + 1).alias("child"), F.slice("template", d + 2, c.depth).alias("below"), "n", "labelled", "blocked")
        shapes = branch.groupBy(*at, "child", "below").agg(F.sum("n").alias("n"))
        kinds = branch.groupBy(*at, "child").agg(*[F.sum(x).alias(x) for x in ("n", "labelled", "blocked")])
        known = kinds.where("labelled > 0")
        pooled = known.groupBy(*at).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum("n").alias("all"))
        usual = shapes.join(known.select(*at, "child"), [*at, "child"], "left_semi").groupBy(*at, "below").agg(F.sum("n").alias("usual"))
        common = (
            shapes.join(kinds.select(*at, "child", F.col("n").alias("own")), [*at, "child"]).join(pooled.select(*at, "all"), at).join(usual, [*at, "below"])
            .groupBy(*at, "child").agg(F.sum(F.least(F.col("n") / F.col("own"), F.col("usual") / F.col("all"))).alias("common"))
        )
        share, own = F.col("b") / F.col("l"), F.col("blocked") / F.col("labelled")
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / F.col("labelled"))
        alike = (F.col("labelled") > 0) & (F.abs(own - share) <= c.errors * error)
        like = kinds.join(pooled.drop("all"), at).join(common, [*at, "child"]).where((F.col("common") >= c.similar) & alike).select(*at, "child", F.lit(True).alias("like"))
        below = F.when(F.size("template") > d, F.slice("template", d + 2, c.depth)).alias("below")
        keyed = out.select("*", F.slice("template", 1, d).alias("above"), F.try_element_at("template", F.lit(d + 1)).alias("child"), below).join(like, [*at, "child"], "left")
        # what stands below merged branches alike is merged with it
        deep = keyed.where("like").groupBy(*at, "below").agg(F.min(F.slice("group", d + 2, c.depth)).alias("deep"))
        keyed = keyed.join(deep, [*at, "below"], "left")
        group = F.concat(F.slice("group", 1, d), F.array(F.lit("~")), F.col("deep"))
        out = cut(keyed.withColumn("group", F.when(F.col("like"), group).otherwise(F.col("group"))).select(*out.columns))
    return out


def judged(counted: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """(host, template, group, n, labelled, blocked, hosts, purity, reject) from ``counted`` (host, template, n, labelled, blocked).

    ``labelled`` and ``blocked`` are those of the merged group; where that has none, ``hosts`` tells how many other
    hosts lend their share of the template.
    """
    c = config
    leaves = merged(counted.groupBy("host", "template").agg(*[F.sum(x).alias(x) for x in ("n", "labelled", "blocked")]), c)
    sums = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    total = leaves.groupBy().agg(*sums).select(F.when(F.col("l") > 0, F.col("b") / F.col("l")).otherwise(0.0)).first()[0]  # one number
    smoothed = lambda b, n, towards: (b + c.prior * towards) / (n + c.prior)
    hosts = leaves.groupBy("host").agg(*sums).select("host", smoothed(F.col("b"), F.col("l"), F.lit(total)).alias("prior"))
    groups = leaves.groupBy("host", "group").agg(*sums).join(hosts, "host")
    own = leaves.select("host", "template", "group", "n").join(groups, ["host", "group"])
    lent = leaves.where("labelled > 0").groupBy("template").agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.col("blocked") / F.col("labelled")).alias("share"))
    both = own.join(lent, "template", "left")
    known = F.col("l") > 0
    purity = F.when(known, smoothed(F.col("b"), F.col("l"), F.col("prior"))).otherwise(smoothed(F.coalesce("share", F.lit(0.0)), F.coalesce("hosts", F.lit(0)), F.lit(total)))
    reject = (known | (F.coalesce("hosts", F.lit(0)) >= c.lenders)) & (purity >= c.reject)
    return both.select("host", "template", "group", "n", F.col("l").alias("labelled"), F.col("b").alias("blocked"), F.when(~known, F.coalesce("hosts", F.lit(0))).alias("hosts"), purity.alias("purity"), reject.alias("reject"))


def url_filter(pages: DataFrame, rules: tuple = RULES, config: TreeConfig = TreeConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict and by of every page; pages with a rule are the labelled ones.

    ``by`` says what gave the verdict: rule, tree, or none (nothing speaks against the page).
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    tree = templates(labelled(distinct.where("host <> ''"), rules), config)
    bad = judged(tree, config).where("reject").select("host", "template")
    # only the paths that the tree rejects and no rule settles meet the pages again
    rejected = tree.where("labelled = 0").join(bad, ["host", "template"], "left_semi").select("host", "path", F.lit(True).alias("rejected"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    out = rows.join(rejected, ["host", "path"], "left").withColumn("r", rule)
    verdict = F.coalesce("r.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    by = F.when(F.col("r").isNotNull(), "rule").when(F.col("rejected"), "tree").otherwise("none")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))


def labelled(paths: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``paths`` (host, path, n) with the numbers of pages that a rule settles, and that it blocks."""
    ruled = paths.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    count = lambda when: F.when(when, F.col("n")).otherwise(0)
    return ruled.select("host", "path", "n", count(F.col("r").isNotNull()).alias("labelled"), count(F.col("r.verdict") == "block").alias("blocked"))
