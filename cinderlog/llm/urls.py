"""URL filters: rules, and a tree of path templates per host for all other pages.

Rules decide first: a rule (verdict, host, path) fits its host and all subdomains
when the path starts with the rule's; the longest wins. Pages that rules decide, and
any labelled pages given, are the evidence for the templates.

The tree is built level by level on counts, not on pages.
1. Each segment is generalised by shape: digits, long hex and identifiers become
   ``*``, a file ending stays (``*.html``).
2. Below a node with more than ``FAN`` different segments, those with less than
   ``RARE`` of the node's pages become ``*``.
3. Labelled sibling branches whose block share does not differ from that of their
   other siblings by a two-proportion test (|z| < ``ALIKE``) become one branch ``*``;
   branches without enough labels (``EVIDENCE``) are not known to be alike and stay.
A template is rejected when its labelled purity reaches ``REJECT``. Purity is the block
share of its labelled pages, smoothed with the weight of ``PRIOR`` pages towards that of
its host; a host's, in which pages without a label count as half, towards that of its
domain (the last two names), and a domain's towards one half. So a host most of whose
pages are known to be bad is rejected where nothing is known too, and without any
evidence pages are allowed.

The tree is followed as deep as two paths of a host go the same way. Only DataFrame
functions are used.

Rows: a null url, or one without "://", has empty host and path and is judged like
any other. Repeated rows are judged each for itself, other columns are ignored; an
empty table gives no rows. Of rules of one length the first listed wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.session import materialise

FAN = 20
RARE = 0.02
ALIKE = 1.96
EVIDENCE = 5
PRIOR = 4
REJECT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parsed_rules(rules: list[str]) -> list[tuple[str, str, str, str]]:
    """(rule, verdict, host, path) of lines like ``block example.com/en/``, longest first."""
    out = []
    for line in rules:
        verdict, rule = line.split()
        host, slash, path = rule.partition("/")
        out.append((rule, verdict, host.lower(), slash + path))
    return sorted(out, key=lambda r: -len(r[0]))


def fitting(host: Column, path: Column, rules: list[str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says, rule_host, rule_path in reversed(parsed_rules(rules)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments by shape."""

    def shape(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1)
        stem = F.substr(s, F.lit(1), F.length(s) - F.length(ending))
        varies = (
            F.rlike(stem, F.lit(r"^[0-9._-]+$"))
            | F.rlike(stem, F.lit(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"))
            | F.rlike(stem, F.lit(r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{12,}$"))
        )
        return F.when(varies, F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/"), shape)


def tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) from counts (host, shape, pages, labelled, blocked)."""
    leaves, ready, level = shapes.withColumn("template", F.col("shape")), [], 0
    while True:
        # a path that shares its node with no other has no siblings from here on
        at = leaves.withColumn("prefix", F.slice("template", 1, level))
        shared = at.groupBy("host", "prefix").agg(F.count("*").alias("_leaves")).where("_leaves > 1")
        at = materialise(at.join(shared, ["host", "prefix"], "left"), "nodes")
        alone = F.col("_leaves").isNull() | (F.size("template") <= level)
        ready.append(at.where(alone).select(leaves.columns))
        going = at.where(~alone)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, ready)
        leaves, level = materialise(merged_at(going, level), "templates"), level + 1


def merged_at(leaves: DataFrame, level: int) -> DataFrame:
    """The leaves, branches at ``level`` that are alike or rare as ``*``."""
    node = ["host", "prefix"]
    # levels above are generalised already, so equal branches have met
    at = leaves.withColumn("child", F.get("template", F.lit(level)))
    branch = at.groupBy(*node, "child").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")))
    enough = F.col("labelled") >= EVIDENCE
    whole = branch.groupBy(*node).agg(
        F.count("*").alias("fan"), F.sum("pages").alias("all_pages"),
        F.sum(F.when(enough, F.col("labelled")).otherwise(0)).alias("all_labelled"),
        F.sum(F.when(enough, F.col("blocked")).otherwise(0)).alias("all_blocked"),
    )
    others = F.col("all_labelled") - F.col("labelled")
    p, q = F.col("blocked") / F.col("labelled"), (F.col("all_blocked") - F.col("blocked")) / others
    pooled = F.col("all_blocked") / F.col("all_labelled")
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others))
    alike = enough & (others > 0) & (F.abs(p - q) <= ALIKE * spread)
    crowd = (F.col("fan") > FAN) & (F.col("pages") < RARE * F.col("all_pages"))
    merged = branch.join(whole, node).where((F.col("child") != "*") & (F.coalesce(alike, F.lit(False)) | crowd))
    merged = merged.select(*node, "child", F.lit(True).alias("merged"))
    return at.join(merged, [*node, "child"], "left").withColumn(
        "template",
        F.when(
            F.col("merged"),
            F.concat("prefix", F.array(F.lit("*")), F.slice("template", level + 2, F.size("template"))),
        ).otherwise(F.col("template")),
    ).select("host", "shape", "pages", "labelled", "blocked", "template")


def purities(leaves: DataFrame) -> DataFrame:
    """(host, template, purity), each level smoothed towards the one above."""
    domain = F.substring_index("host", ".", -2).alias("domain")
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
    hosts = leaves.groupBy("host").agg(*sums).select("*", domain)
    known = F.col("blocked") + (F.col("pages") - F.col("labelled")) / 2
    of_domain = (F.sum(known) + PRIOR / 2) / (F.sum("pages") + PRIOR)
    domains = hosts.groupBy("domain").agg(of_domain.alias("above"))
    of_host = (known + PRIOR * F.col("above")) / (F.col("pages") + PRIOR)
    hosts = hosts.join(domains, "domain").select("host", of_host.alias("above"))
    purity = (F.col("blocked") + PRIOR * F.col("above")) / (F.col("labelled") + PRIOR)
    return leaves.groupBy("host", "template").agg(*sums).join(hosts, "host").select(
        "host", "template", purity.alias("purity")
    )


def judge(pages: DataFrame, rules: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    ``labels`` (page_id, blocked) adds evidence beside the rules.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("says"), segments(F.col("path")).alias("shape"))
    seen = rows.select("page_id", "host", "shape", (F.col("says") == "block").cast("long").alias("blocked"))
    if labels is not None:
        more = labels.groupBy("page_id").agg(F.max(F.col("blocked").cast("long")).alias("more"))
        seen = seen.join(more, "page_id", "left").withColumn("blocked", F.coalesce("blocked", "more"))
    counts = seen.groupBy("host", "shape").agg(
        F.count("*").alias("pages"), F.count("blocked").alias("labelled"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"),
    )
    leaves = tree(materialise(counts, "shapes"))
    known = leaves.select("host", "shape", "template").join(purities(leaves), ["host", "template"])
    judged = rows.join(known, ["host", "shape"], "left")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity",
    )
