"""URL filter by fixed rules and a tree of path templates.

Paths are first written with typed wildcards ({n}, {hex}, ...), which leaves few
shapes per host.  The tree is then built level by level over the shapes: of the
children of a node, rare ones become ``*``, and labelled branches whose bad rates
do not differ significantly are merged.  A template is rejected if its
smoothed share of bad labels is high enough.  All steps are aggregates and joins
over shapes; pages are aggregated before the tree and joined to it after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import materialize

# (verdict, host and path); fixed values of the task.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Segments below this depth are one tail.
MAX_DEPTH = 8
# A child stays a branch of its own with this share and number of its parent's
# pages; of few children all stay.
MIN_SHARE, MIN_PAGES, FEW_CHILDREN = 0.01, 5, 8
# Two branches are alike below this z value, given so many labels in each.
ALIKE_Z, MIN_LABELS = 1.96, 5
# Added labels of each kind, and the smoothed share from which a template is rejected.
SMOOTHING, REJECT_SHARE = 1.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TYPES = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(\.\w+)?$", "{uuid}$1"),
    (r"^\d{4}-\d{2}-\d{2}(\.\w+)?$", "{date}$1"),
    (r"^\d+(\.[A-Za-z]\w*)?$", "{n}$1"),
    (r"^(?=\D*\d)[0-9a-fA-F]{8,}(\.\w+)?$", "{hex}$1"),
    (r"^(.*?)[-_]?\d+(\.[A-Za-z]\w*)?$", "$1{n}$2"),
)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    pattern, text = r"^(?s).*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _shape(path: Column) -> Column:
    """Segments of a path with typed wildcards, the last one holding any deeper rest."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", MAX_DEPTH)

    def typed(segment: Column) -> Column:
        out = segment
        for pattern, name in reversed(_TYPES):
            out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, name)).otherwise(out)
        return out

    return F.transform(segments, typed)


def _branches(shapes: DataFrame, depth: int) -> DataFrame:
    """Rows (host, template, token, branch) of one level of the tree."""
    token = F.get("shape", F.lit(depth)).alias("token")
    children = shapes.where(F.size("shape") > depth).groupBy("host", "template", token).agg(
        F.sum("pages").alias("pages"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad")
    )
    nodes = children.groupBy("host", "template").agg(F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("kids"))
    children = children.join(nodes, ["host", "template"])
    stays = (F.col("kids") <= FEW_CHILDREN) | ((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages")))
    children = materialize(children.withColumn("name", F.when(stays, F.col("token")).otherwise("*")).drop("all_pages", "kids"), "children")
    # At most FEW_CHILDREN or 1 / MIN_SHARE names and the wildcard per node from here on.
    named = children.groupBy("host", "template", "name").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    known = named.where(F.col("labels") >= MIN_LABELS).withColumn("rate", F.col("bad") / F.col("labels"))
    order = Window.partitionBy("host", "template").orderBy("rate", "name")
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("bad") + before("bad")) / (F.col("labels") + before("labels"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / before("labels")))
    apart = F.when(before("labels").isNull(), 0).when(spread > 0, ((F.col("rate") - before("rate")) / spread > ALIKE_Z).cast("int")).otherwise((F.col("rate") != before("rate")).cast("int"))
    runs = known.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
    merged = runs.groupBy("host", "template", "run").agg(F.sort_array(F.collect_list("name")).alias("names"))
    merged = merged.select("host", "template", F.explode("names").alias("name"), F.array_join("names", "|").alias("merged"))
    branch = named.select("host", "template", "name").join(merged, ["host", "template", "name"], "left")
    branch = branch.select("host", "template", "name", F.coalesce("merged", "name").alias("branch"))
    return children.select("host", "template", "token", "name").join(branch, ["host", "template", "name"]).select("host", "template", "token", "branch")


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, path, bad) with bad 1, 0 or null to (host, shape, template, reject).

    bad is the label of a page, null where it has none.
    """
    shapes = pages.groupBy("host", _shape(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    shapes = materialize(shapes.withColumn("template", F.lit("")), "shapes")
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for depth in range(deepest):
        level = _branches(shapes, depth).withColumnsRenamed({"host": "__host", "template": "__template", "token": "__token"})
        fits = (F.col("host") == F.col("__host")) & (F.col("template") == F.col("__template")) & (F.get("shape", F.lit(depth)) == F.col("__token"))
        grown = shapes.join(level, fits, "left")
        grown = grown.withColumn("template", F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")))
        shapes = materialize(grown.drop("__host", "__template", "__token", "branch"), "shapes")
    totals = shapes.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    share = (F.col("bad") + SMOOTHING) / (F.col("labels") + 2 * SMOOTHING)
    totals = totals.select(F.col("host").alias("__host"), F.col("template").alias("__template"), share.alias("bad_share"), (share >= REJECT_SHARE).alias("reject"))
    same = (F.col("host") == F.col("__host")) & (F.col("template") == F.col("__template"))
    return shapes.join(totals, same).select("host", "shape", "template", "bad_share", "reject")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, bad_share), one per input row.

    ``labels`` (page_id, bad) are labelled pages, one row per id; without them the
    pages that a rule judges are the labelled ones.  A rule decides alone; other
    pages are blocked if their template is rejected.  A template without
    labels is allowed.  Null urls have an empty host and path and are judged
    like the others.
    """
    host, path = parts_of(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = materialize(found.withColumns({"rule": name, "ruled": verdict}), "urls")
    if labels is None:
        labelled = found.withColumn("bad", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    else:
        known = labels.select(F.col("page_id").alias("__page"), F.col("bad").cast("int").alias("bad"))
        labelled = found.join(known, F.col("page_id") == F.col("__page"), "left")
    tree = templates(labelled.select("host", "path", "bad")).withColumnsRenamed({"host": "__host", "shape": "__shape"})
    judged = found.join(tree, (F.col("host") == F.col("__host")) & (_shape(F.col("path")) == F.col("__shape")), "left")
    final = F.coalesce("ruled", F.when(F.col("reject"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", final.alias("verdict"), "template", "bad_share")
