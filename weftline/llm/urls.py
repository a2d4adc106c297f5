"""URL filter: explicit rules first, then a path-template tree for every host.

Each url falls to a host and a path. Rules such as ``org/`` decide the urls they fit.
The rest is judged by a tree of path templates: digit runs are wildcards from the start,
then, level by level, segments that are rare among many siblings become ``*``. Sibling
branches whose subtrees look alike and whose labelled rates do not differ significantly
are pooled. A template is rejected when its labelled block rate, smoothed towards its
host's and that towards the corpus rate, reaches ``reject_at``; without a label on its host
it is not.

Labels come from the rules' own verdicts, from the caller's table of labelled pages if there
is one, and else from seed words in host names.

Edge cases: null urls and urls without ``://`` have an empty host and path and get the
template ````; they share one tree. Repeated rows are judged alike and all kept. An empty
table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import ascii_lower, persist

#: (verdict, rule): a host suffix, then a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark a host as labelled "block" when they stand between its separators.
SEED_WORDS = ("casino", "pills", "adult", "bets", "spam", "porn", "ads", "gambling")
DEPTH = 4


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    suffix, _, prefix = rule.partition("/")
    return ((host == suffix) | host.endswith("." + suffix)) & path.startswith("/" + prefix)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        fits = rule_fits(r, host, path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def path_shape(path: Column) -> Column:
    """The path with its digit runs as ``#``."""
    return F.regexp_replace(path, r"[0-9]+", "#")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    seed_words=SEED_WORDS,
    depth: int = DEPTH,
    max_siblings: int = 12,
    min_share: float = 0.05,
    smoothing: int = 5,
    reject_at: float = 0.8,
    z: float = 2.0,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, labelled, blocked.

    ``labelled`` has rows (url, block), block 1 or 0; they label the tree in place of the seed
    words, and need not be urls of ``pages``.

    The tree is built on counts per (host, path shape), so its cost follows the number of
    distinct shapes; the pages themselves take part in one equi-join at the end, whose
    small side AQE broadcasts only after measuring it, and whose hot keys it splits.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "shape": path_shape(F.col("path"))})
    seeded = F.col("host").rlike(r"(^|[.-])(" + "|".join(seed_words) + r")([.-]|$)") if seed_words and labelled is None else F.lit(False)
    label = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("long")).when(seeded, F.lit(1).cast("long"))
    votes = rows.select("host", "shape", F.lit(1).cast("long").alias("n"), label.alias("label"))
    if labelled is not None:
        host, path = split_url(F.col("url"))
        own = labelled.select(F.coalesce(host, F.lit("")).alias("host"), path_shape(F.coalesce(path, F.lit(""))).alias("shape"), F.lit(0).cast("long").alias("n"), F.col("block").cast("long").alias("label"))
        votes = votes.unionByName(own)
    tree = shape_verdicts(votes, depth, max_siblings, min_share, smoothing, reject_at, z)
    out = rows.join(tree, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree").alias("verdict"), "template", "labelled", "blocked")


def shape_verdicts(votes: DataFrame, depth: int, max_siblings: int, min_share: float, smoothing: int, reject_at: float, z: float) -> DataFrame:
    """host, shape, template, labelled, blocked, by_tree from rows (host, shape, n, label)."""
    shapes = votes.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0).cast("long")).alias("blocked"))
    shapes = persist(shapes).withColumns({"segments": F.split("shape", "/"), "template": F.lit("")})
    for level in range(1, depth + 1):  # segment 0 is what stands before the first slash: nothing
        segment = F.when(F.size("segments") > level, F.element_at("segments", level + 1))
        shapes = shapes.withColumn("segment", segment)
        children = shapes.filter(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(F.sum("n").alias("child_n"))
        # sums joined back, not a window: a host may have any number of segments at one place
        siblings = children.groupBy(F.col("host").alias("ph"), F.col("template").alias("pt")).agg(F.count("*").alias("siblings"), F.sum("child_n").alias("siblings_n"))
        children = children.join(siblings, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("pt"))).select(
            F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"),
            ((F.col("siblings") > max_siblings) & (F.col("child_n") < min_share * F.col("siblings_n"))).alias("variable"),
        )
        joined = shapes.join(children, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("segment") == F.col("s")), "left")
        step = F.when(F.col("segment").isNull(), F.lit("")).when(F.col("variable"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("segment")))
        shapes = persist(joined.withColumn("template", F.concat("template", step)).drop("h", "t", "s", "variable", "segment"))
    shapes = shapes.withColumn("template", F.when(F.size("segments") > depth + 1, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))

    templates = shapes.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    # Branches of one host that differ in the first segment only have the same remainder.
    templates = templates.withColumns({"branch": F.substring_index(F.col("template"), "/", 2), "below": F.regexp_replace("template", r"^/[^/]*", "")})
    branches = templates.groupBy("host", "branch").agg(F.sum("labelled").alias("b_labelled"), F.sum("blocked").alias("b_blocked"), F.concat_ws("\n", F.sort_array(F.collect_set("below"))).alias("subtree"))
    alike = Window.partitionBy("host", "subtree")
    branches = branches.withColumns({"g_labelled": F.sum("b_labelled").over(alike), "g_blocked": F.sum("b_blocked").over(alike)})
    # |b/nb - g/ng| <= z * sqrt(p(1-p)/nb) squared and cleared of its divisions. Products of counts pass 2^63 on hot hosts, hence the decimals.
    b_labelled, b_blocked, g_labelled, g_blocked = (F.col(c).cast("decimal(19,0)") for c in ("b_labelled", "b_blocked", "g_labelled", "g_blocked"))
    gap = (b_blocked * g_labelled - g_blocked * b_labelled).cast("double")
    near = gap * gap <= z * z * (g_blocked * (g_labelled - g_blocked) * b_labelled).cast("double")
    branches = branches.withColumn("pool", F.when(near, F.col("subtree")).otherwise(F.concat(F.lit("/"), F.col("branch"))))
    # the host and pool columns are compared under other names, since both sides derive from one table
    named = branches.select(F.col("host").alias("h"), F.col("branch").alias("b"), "pool")
    pooled = templates.join(named, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("b"))).drop("h", "b")
    same, whole = Window.partitionBy("host", "pool", "below"), Window.partitionBy("host")
    pooled = pooled.select("host", "template", *(F.sum(c).over(same).alias(c) for c in ("labelled", "blocked")), F.sum("labelled").over(whole).alias("h_labelled"), F.sum("blocked").over(whole).alias("h_blocked"))
    m = float(smoothing)
    rate = (F.coalesce(F.sum("blocked"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)
    prior = templates.agg(rate.alias("prior")).scalar()
    of_host = (F.col("h_blocked") + m * prior) / (F.col("h_labelled") + m)
    purity = (F.col("blocked") + m * of_host) / (F.col("labelled") + m)
    judged = pooled.select("host", "template", "labelled", "blocked", F.when((purity >= reject_at) & (F.col("h_labelled") > 0), "block").otherwise("allow").alias("by_tree"))
    return shapes.select(F.col("host"), F.col("shape"), F.col("template")).join(judged, ["host", "template"])
