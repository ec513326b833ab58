"""URL filters: rules on hosts and paths, and, where no rule fits, a tree of path templates for each host.

The tree is built from counts, never from rows. Segments are first given shapes (numbers, identifiers and file names
become wildcards), and equal paths of a host are counted together with the labels on them. Then the tree is walked from
the root. Below each node rare branches are one wildcard, and branches whose labels deviate from their siblings' in the
same direction, or not at all, are merged (a normal test of the branch's labelled blocks against the rate of its
parent). A branch without labels joins those of its labelled siblings whose children are distributed most like its own,
if at least `near` of the two distributions overlap, and else the other branches without labels.

A template is rejected if its purity reaches one half. Purity is the share of blocked rows among its labelled rows,
smoothed by `weight` rows of its parent's purity, and so on up: path, host, the host's last two labels, and there by the
prior. So a template without labels of its own is judged by what is known nearest to it, and allowed where nothing is.

Everything here is DataFrame functions; no Python runs on executors.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
template of the empty host; repeated rows each get their own result, and are counted as often; an empty table gives an
empty result. Columns other than the url are kept; columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, fresh, spread_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Levels of the tree that are told apart; what lies deeper is one wildcard.
DEPTH = 6
#: Rows with one host and shape that one task meets with their template.
SPREAD = 1_000_000
SEP = "\x1f"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path of the url; both empty if it is null or has no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1),
        }
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. The rules are a short configured list: one expression."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, tail = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(tail))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(path: Column) -> Column:
    """Segments of a path with variable parts as wildcards: # for numbers, with or without a file ending, * for other
    segments that hold digits or are longer than 40 characters; after DEPTH segments one **."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(
        segments,
        lambda s: F.when(s.rlike(r"\A[0-9]+(\.[A-Za-z]{1,5})?\z"), F.lit("#")).when(s.rlike("[0-9]") | (F.length(s) > 40), F.lit("*")).otherwise(F.translate(s, SEP, "*")),
    )
    return F.when(F.size(named) > DEPTH, F.concat(F.slice(named, 1, DEPTH), F.array(F.lit("**")))).otherwise(named)


def smoothed(blocked, labelled, base, weight: float) -> Column:
    return (blocked + weight * base) / (labelled + weight)


def host_rates(counted: DataFrame, weight: float, prior: float) -> DataFrame:
    """(host, rate): the smoothed share of blocked rows of each host, over its last two labels', over the prior."""
    labels = F.split("host", r"\.")
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    hosts = counted.groupBy("host").agg(*sums).withColumn("site", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."))
    sites = hosts.groupBy("site").agg(*sums).select("site", smoothed(F.col("blocked"), F.col("labelled"), F.lit(prior), weight).alias("base"))
    return hosts.join(sites, "site").select("host", smoothed(F.col("blocked"), F.col("labelled"), F.col("base"), weight).alias("rate"))


def path_templates(counted: DataFrame, rare: float = 0.02, many: int = 12, z: float = 1.96, weight: float = 4.0, prior: float = 0.1, near: float = 0.5) -> DataFrame:
    """counted (host, shape, n, labelled, blocked) with template and purity; one row for each row.

    rare, many: a branch with less than this share of its parent's rows is variable if the parent has `many` branches or
    more. z: how far a branch's blocked rows may lie from what its parent's rate gives before it counts as deviating."""
    scratch = Scratch(counted.sparkSession, "url-tree")
    counted = scratch.stored(counted)
    depth = counted.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = scratch.stored(counted.join(host_rates(counted, weight, prior), "host").withColumn("prefix", F.lit("")))
    for d in range(depth):  # at most DEPTH + 1 rounds, over counts
        here = tree.withColumns({"seg": F.coalesce(F.get("shape", F.lit(d)), F.lit("")), "next": F.coalesce(F.get("shape", F.lit(d + 1)), F.lit(""))})
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        fine = scratch.stored(here.groupBy("host", "prefix", "seg", "next").agg(*sums, F.first("rate").alias("rate")))
        kids = fine.groupBy("host", "prefix", "seg").agg(*sums, F.first("rate").alias("rate"))
        parents = kids.groupBy("host", "prefix").agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"p_{c}") for c in ("n", "labelled", "blocked")))
        rate = (F.col("p_blocked") + 1) / (F.col("p_labelled") + 2)
        away = (F.col("blocked") - F.col("labelled") * rate) / F.sqrt(F.greatest(F.col("labelled") * rate * (1 - rate), F.lit(1e-9)))
        side = F.when(F.col("labelled") == 0, "?").when(away > z, "+").when(away < -z, "-").otherwise("=")
        variable = (F.col("kids") >= many) & (F.col("n") < rare * F.col("p_n"))
        branch = F.when(F.col("seg") == "", "").when(variable, "*").otherwise(F.concat(F.lit("~"), side))
        judged = scratch.stored(kids.join(parents, ["host", "prefix"]).select("host", "prefix", "seg", "n", "labelled", "blocked", "rate", branch.alias("branch")))

        shares = fine.select("host", "prefix", "seg", "next", F.col("n").alias("m")).join(judged.select("host", "prefix", "seg", "n", "branch"), ["host", "prefix", "seg"])
        known = shares.where(F.col("branch").isin("~+", "~-", "~=")).groupBy("host", "prefix", "branch", "next").agg(F.sum("m").alias("m"))
        whole = known.groupBy("host", "prefix", "branch").agg(F.sum("m").alias("n"))
        known = known.join(whole, ["host", "prefix", "branch"]).select("host", "prefix", "next", F.col("branch").alias("like"), (F.col("m") / F.col("n")).alias("q"))
        met = shares.where("branch = '~?'").join(known, ["host", "prefix", "next"])  # at most three groups for each
        overlap = met.groupBy("host", "prefix", "seg", "like").agg(F.sum(F.least(F.col("m") / F.col("n"), F.col("q"))).alias("overlap"))
        nearest = overlap.where(F.col("overlap") >= near).groupBy("host", "prefix", "seg").agg(F.max_by("like", F.struct("overlap", "like")).alias("like"))
        judged = judged.join(nearest, ["host", "prefix", "seg"], "left").withColumn("branch", F.coalesce("like", "branch"))

        groups = judged.groupBy("host", "prefix", "branch").agg(F.count("*").alias("members"), F.sum("labelled").alias("g_labelled"), F.sum("blocked").alias("g_blocked"), F.first("rate").alias("base"))
        own = F.when((F.col("members") == 1) & (F.col("branch") != "*"), F.col("seg")).otherwise(F.col("branch"))
        deeper = F.when(F.col("branch") == "", F.col("base")).otherwise(smoothed(F.col("g_blocked"), F.col("g_labelled"), F.col("base"), weight))
        named = judged.select("host", "prefix", "seg", "branch").join(groups, ["host", "prefix", "branch"]).select("host", "prefix", "seg", own.alias("name"), deeper.alias("rate"))
        below = F.when(F.col("name") == "", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "name"))
        tree = scratch.stored(here.drop("rate", "next").join(named, ["host", "prefix", "seg"]).withColumn("prefix", below).drop("seg", "name"))
    merged = tree.groupBy("host", "prefix").agg(F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"), F.first("rate").alias("base"))
    return scratch.cleared(
        tree.join(merged, ["host", "prefix"]).select("host", "shape", "n", F.col("prefix").alias("template"), smoothed(F.col("t_blocked"), F.col("t_labelled"), F.col("base"), weight).alias("purity"))
    )


def filter_urls(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, reject: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict, and, where no rule fits, template and purity. Rows that a rule judges are the
    labelled rows of the tree."""
    own = {n: fresh(df, n) for n in ("fit", "shape", "template", "purity")}
    rows = with_parts(df, url).withColumn(own["fit"], fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(own["shape"], F.array_join(shape(F.col("path")), SEP))
    label = F.col(own["fit"])["verdict"]
    counted = rows.groupBy("host", F.col(own["shape"]).alias("shape")).agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(label == "block").alias("blocked"))
    counted = counted.withColumn("shape", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", SEP)))
    judged = path_templates(counted).select("host", F.array_join("shape", SEP).alias(own["shape"]), "n", F.col("template").alias(own["template"]), F.col("purity").alias(own["purity"]))
    met = spread_join(rows, judged, ["host", own["shape"]], SPREAD)
    free = F.col(own["fit"]).isNull()
    return met.withColumns(
        {
            "rule": F.col(own["fit"])["rule"],
            "template": F.when(free, F.col(own["template"])),
            "purity": F.when(free, F.col(own["purity"])),
            "verdict": F.coalesce(label, F.when(F.col(own["purity"]) >= reject, "block").otherwise("allow")),
        }
    ).drop(*own.values())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
