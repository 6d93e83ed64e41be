"""URL filters by a path-template tree, in DataFrame functions only.

Explicit rules (host, path prefix, verdict) come first: a rule fits its host and all subdomains,
and the longest fitting rule decides. Pages decided by a rule are the labelled pages of the tree.

Per host, paths become templates. Segments of digits, hex strings and long mixed tokens turn into
wildcards at once; then, level by level from the root, a branch with many rarely used children
turns them into one wildcard, and siblings that look alike statistically are merged: the same bin
of their smoothed share of blocked pages (bins are even in the arcsine of the root of the share,
so one bin is about one standard error at ``BIN_PAGES`` pages) and the same kind of subtree (pages
end there, or go on below). Each merged branch is named after its first member. A template is
rejected if its purity, the share of blocked among its labelled pages smoothed to the share in the
corpus, is high enough. A template without enough labelled pages is never rejected.

Pages are aggregated to (host, first template) before any other step, so the tree works on counts
and a host with a third of all pages costs as many rows as it has templates. A round follows each
chain of nodes with a single child to its end and then merges one branching level, and is written once;
paths that have ended leave. So there are as many rounds as branchings on one path, not as many as
segments. The last join takes verdicts back to pages by (host, first template).

Defined results: a null url, or one without ``://``, has empty host and path and no rule; a url of
any length is judged whole; repeated rows are judged alike; members of a merged branch are named
after the least; an empty table gives an empty result; extra columns pass through, and the new name
clashes with none of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, stored, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A branch with more children than this, and fewer pages a child than that, gets one wildcard.
CHILDREN, PAGES_EACH = 32, 8
BIN_PAGES, PRIOR_PAGES, LEAST_LABELLED, PURITY = 25, 2.0, 5, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<rule:string,verdict:string>")


def first_template(path: Column) -> Column:
    """Segments with ids replaced by wildcards, the extension kept."""
    parts = F.array_remove(F.split(path, "/"), "")
    ids = ("^([0-9]+|[0-9a-fA-F-]{12,}|(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{16,})(\\.[A-Za-z]{1,5})?$", "*$2")
    return F.transform(parts, lambda s: F.regexp_replace(s, *ids))


def share_bin(blocked: Column, labelled: Column, prior: float) -> Column:
    """Bin of the smoothed share; -1 without enough labelled pages."""
    share = (blocked + PRIOR_PAGES * prior) / (labelled + PRIOR_PAGES)
    return F.when(labelled < LEAST_LABELLED, F.lit(-1)).otherwise(
        F.floor(F.asin(F.sqrt(share)) * 2 * BIN_PAGES ** 0.5).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading segments that two paths share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def along_chains(t: DataFrame) -> DataFrame:
    """Every template made longer as far as the paths under it that go on do not part.

    Such nodes have one child each, so there is nothing to merge; paths that end on the way end there.
    """
    key = ["host", "template"]
    longest = t.groupBy(*key).agg(F.max("rest").alias("longest"))
    t = t.join(longest, key).withColumn("same", common_prefix(F.col("rest"), F.col("longest"))).drop("longest")
    parts_at = t.groupBy(*key).agg(F.min(F.when(F.col("same") < F.size("rest"), F.col("same"))).alias("cut"))
    t = t.join(parts_at, key).withColumn("step", F.least(F.coalesce("cut", F.size("rest")), F.size("rest")))
    passed = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("step")), lambda x: F.concat(F.lit("/"), x)), "")
    return t.withColumn("template", F.concat("template", passed)).withColumn(
        "rest", F.slice("rest", F.col("step") + 1, F.size("rest"))).drop("same", "cut", "step")


def template_tree(leaves: DataFrame, prior: float) -> DataFrame:
    """(host, first, template, pages, labelled, blocked) from leaves (host, first, pages, labelled, blocked)."""
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
    names = ["host", "first", "template", "pages", "labelled", "blocked"]
    t, done = leaves.withColumns({"template": F.lit(""), "rest": F.col("first")}), []
    while True:
        t = stored(along_chains(t), "templates")
        done.append(t.where(F.size("rest") == 0).select(*names))
        t = t.where(F.size("rest") > 0).withColumn("segment", F.get("rest", F.lit(0)))
        if t.isEmpty():
            return reduce(DataFrame.unionByName, done)
        nodes = t.groupBy("host", "template", "segment").agg(*sums, F.max(F.size("rest") > 1).alias("inner"))
        parents = nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("all_pages"))
        wide = (F.col("children") > CHILDREN) & (F.col("all_pages") < PAGES_EACH * F.col("children"))
        nodes = nodes.join(parents, ["host", "template"]).withColumn(
            "class", F.when(wide, F.lit("*")).otherwise(F.concat_ws(
                "|", share_bin(F.col("blocked"), F.col("labelled"), prior), F.col("inner"))))
        classes = nodes.groupBy("host", "template", "class").agg(
            F.min("segment").alias("least"), F.count(F.lit(1)).alias("members"))
        longer = nodes.join(classes, ["host", "template", "class"]).select(
            "host", "template", "segment", F.concat("template", F.lit("/"), F.when(F.col("class") == "*", F.lit("*")).when(
                F.col("members") > 1, F.concat("least", F.lit("~"))).otherwise(F.col("segment"))).alias("longer"))
        t = t.join(longer, ["host", "template", "segment"]).select(
            "host", "first", "pages", "labelled", "blocked", F.col("longer").alias("template"),
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES) -> tuple[DataFrame, str]:
    """All columns of ``pages`` plus one struct (host, path, rule, verdict, template, purity); its name is returned."""
    name, key_host, key_first = fresh(pages, "url_", "tree_host", "tree_first")
    host, path = host_and_path(col(url))
    p = pages.withColumn(name, F.struct(host.alias("host"), path.alias("path")))
    p = p.withColumn(name, F.struct(col(name)["host"].alias("host"), col(name)["path"].alias("path"),
                                    rule_of(col(name)["host"], col(name)["path"], rules).alias("rule"),
                                    first_template(col(name)["path"]).alias("first")))
    of = lambda v: F.sum(F.when(F.col("v") == v, 1).otherwise(0)).alias(v)
    leaves = (p.select(col(name)["host"].alias("host"), col(name)["first"].alias("first"), col(name)["rule"]["verdict"].alias("v"))
              .groupBy("host", "first").agg(F.count(F.lit(1)).alias("pages"), of("block"), of("allow"))
              .select("host", "first", "pages", (F.col("block") + F.col("allow")).alias("labelled"), F.col("block").alias("blocked")))
    leaves = stored(leaves, "templates")
    seen = leaves.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    prior = seen["b"] / seen["n"] if seen["n"] else 0.0
    tree = template_tree(leaves, prior)
    judged = (tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
              .withColumn("purity", (F.col("blocked") + PRIOR_PAGES * prior) / (F.col("labelled") + PRIOR_PAGES))
              .withColumn("rejected", (F.col("labelled") >= LEAST_LABELLED) & (F.col("purity") >= PURITY)))
    leaf = tree.select("host", "first", "template").join(judged, ["host", "template"]).select(
        F.col("host").alias(key_host), F.col("first").alias(key_first), "template", "labelled", "purity", "rejected")
    found = F.struct(leaf["template"], leaf["labelled"], leaf["purity"], leaf["rejected"])
    (tree_name,) = fresh(p, "tree_")
    leaf = leaf.select(key_host, key_first, found.alias(tree_name))
    x, t = col(name), col(tree_name)
    out = p.join(leaf, (p[name]["host"] == leaf[key_host]) & (p[name]["first"] == leaf[key_first]), "left")
    return out.withColumn(name, F.struct(
        x["host"].alias("host"), x["path"].alias("path"), x["rule"]["rule"].alias("rule"),
        F.coalesce(x["rule"]["verdict"], F.when(t["rejected"], F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        t["template"].alias("template"), t["labelled"].alias("labelled"),
        F.round(t["purity"], 6).alias("purity"))).select(*[col(c) for c in pages.columns], col(name)), name


def op10_url_templates(spark, sf_dir):
    judged, name = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[f"{name}.{c}" for c in ("host", "path", "rule", "verdict", "template", "labelled", "purity")])


QUERIES = {"op10_url_templates": op10_url_templates}
