"""URL filter: host and path rules, then a path-template tree learnt from the urls that the rules decide.

Every path is a chain of segments under its host. Segments that cannot repeat by nature (numbers, long hexadecimal or
mixed tokens) become wildcards at once; of the others, those whose parent has many children that hardly ever repeat
become wildcards too, level by level, down to a given depth; what is deeper is all wildcards. At each of these levels
the children of a node whose labelled block shares do not differ significantly from the node's are merged and share
their evidence. A template is rejected when its smoothed labelled purity - the share of blocked urls, pulled towards
that of its branch, level by level up to the host's, and that towards the corpus' - reaches a threshold.

Only DataFrame operations: counts are aggregated before they are shuffled, one row per distinct (host, template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
WILD = "*"


def host_of(url: str = "url") -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null: looked up by the host's suffixes in a map."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for nth, (verdict, rule_host, prefix) in enumerate(rules):
        text = rule_host + prefix
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(text)).alias("len"), F.lit(-nth).alias("nth"), F.lit(prefix).alias("prefix"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict")))
    known = F.create_map(*[x for h, entries in by_host.items() for x in (F.lit(h), F.array(*entries))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["prefix"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def shape_of(path: Column) -> Column:
    """The path with every segment that holds a digit or is a long hexadecimal token replaced by a wildcard; a short
    file ending stays."""
    segment = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"[0-9]|^[a-fA-F-]{16,}$"), F.concat(F.lit(WILD), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))
    return F.array_join(segment, "/")


def template_tree(shapes: DataFrame, *, depth: int = 3, min_children: int = 8, min_variety: float = 0.5) -> DataFrame:
    """Rows (host, shape, n, ...), one per host and shape -> the same with `template` and its beginnings node_1 to node_depth.

    Level by level, the children of a node (host and template so far) become a wildcard where there are at least
    min_children of them and their number is at least min_variety of the urls below. Segments beyond `depth` become
    wildcards. The nodes that turn wild are a written table, so that a host with very many shapes can be split.
    """
    parts = F.slice(F.split("shape", "/"), 2, 2**31 - 1)
    tree = shapes.withColumn("_parts", parts).withColumn("template", F.lit(""))
    for level in range(1, depth + 1):
        tree = tree.withColumn("_segment", F.try_element_at("_parts", F.lit(level)))
        children = tree.where(F.col("_segment").isNotNull()).groupBy("host", "template", "_segment").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("below"))
        wild = nodes.where((F.col("children") >= min_children) & (F.col("children") >= min_variety * F.col("below")))
        tree = tree.join(written(wild.select("host", "template", F.lit(True).alias("_wild")), "url-wild"), ["host", "template"], "left")
        segment = F.when(F.col("_wild") & (F.col("_segment") != ""), F.lit(WILD)).otherwise(F.col("_segment"))
        tree = tree.withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), segment), F.lit("")))).drop("_segment", "_wild")
        tree = tree.withColumn(f"node_{level}", F.col("template"))
    deeper = F.when(F.size("_parts") > depth, F.concat(F.lit("/"), F.array_join(F.transform(F.slice("_parts", depth + 1, 2**31 - 1), lambda s: F.lit(WILD)), "/"))).otherwise(F.lit(""))
    return tree.withColumn("template", F.concat("template", deeper)).drop("_parts")


def template_purity(tree: DataFrame, *, depth: int = 3, z: float = 1.96, strength: float = 8.0) -> DataFrame:
    """(host, shape, template, node_1 to node_depth, n_labelled, n_block) -> host, shape, template, purity.

    Level by level, the children of a node whose block share differs from the node's by no more than z standard errors,
    and those without labels, share the evidence of all such children of that node. purity pulls a template's share
    towards the evidence of its deepest node, that towards the one above, up to the host, that towards the corpus, each by
    `strength` pseudo-observations. Unlabelled templates get what they are pulled to. The corpus' share counts for at most
    one half: labels of other hosts alone never condemn a host.
    """
    keys = ["host", *(f"node_{level}" for level in range(1, depth + 1))]

    def sums(rows: DataFrame, keys: tuple[str, ...], k: str, n: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(k).cast("double").alias("k" + name), F.sum(n).cast("double").alias("n" + name))

    def pulled(name: str, towards: Column) -> Column:
        return (F.col("k" + name) + strength * towards) / (F.col("n" + name) + strength)

    share = F.coalesce(F.sum("n_block") / F.nullif(F.sum("n_labelled"), F.lit(0)), F.lit(0.0))
    total = tree.agg(F.least(share, F.lit(0.5)).alias("prior"))
    # sums from templates up to hosts, each level from the one below it, and joined back by plain joins that Spark can split
    templates = written(sums(tree, (*keys, "template"), "n_block", "n_labelled", "t"), "url-sums")
    nodes = {depth: written(sums(templates, tuple(keys), "kt", "nt", "c"), "url-nodes")}
    for level in range(depth - 1, -1, -1):
        nodes[level] = written(sums(nodes[level + 1], tuple(keys[: level + 1]), "kc", "nc", "c"), "url-nodes")
    above = nodes[0].crossJoin(F.broadcast(total))  # one row
    above = above.select("host", F.col("kc").alias("kp"), F.col("nc").alias("np"), pulled("c", F.col("prior")).alias("above"))
    share = F.when(F.col("np") > 0, F.col("kp") / F.col("np")).otherwise(F.lit(0.0))
    error = F.sqrt(share * (1 - share) * (1 / F.col("nc") + 1 / F.col("np")))
    alike = F.when(F.col("nc") == 0, F.lit(True)).otherwise(F.abs(F.col("kc") / F.col("nc") - share) <= z * error)
    for level in range(1, depth + 1):
        judged = written(nodes[level].join(above, keys[:level]).withColumn("alike", alike), "url-alike")
        merged = written(sums(judged.where("alike"), tuple(keys[:level]), "kc", "nc", "a"), "url-merged")
        judged = judged.join(merged, keys[:level], "left")
        judged = judged.withColumn("ke", F.when(F.col("alike"), F.col("ka")).otherwise(F.col("kc"))).withColumn("ne", F.when(F.col("alike"), F.col("na")).otherwise(F.col("nc")))
        above = judged.select(*keys[: level + 1], F.col("kc").alias("kp"), F.col("nc").alias("np"), pulled("e", F.col("above")).alias("above"))
    found = templates.join(above, keys).select("host", "template", pulled("t", F.col("above")).alias("purity"))
    return tree.select("host", "shape", "template").join(written(found, "url-purity"), ["host", "template"])


def url_filter(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.75, depth: int = 3, strength: float = 8.0) -> DataFrame:
    """Judge every url. Returns page_id, host, path, rule, verdict, template, purity, one row per input row.

    The longest rule that fits decides and labels its template; the template tree judges the other urls: block where
    the template's purity is at least `threshold`, else allow. Null urls and urls without :// have empty host and path.
    Rows that repeat are judged alike. Without any labelled url all purities are 0 and all other urls are allowed.
    """
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("found").alias("n_labelled"), F.count_if(F.col("found.verdict") == "block").alias("n_block")
    )
    tree = written(template_tree(shapes, depth=depth), "url-tree")
    judged = written(template_purity(tree, depth=depth, strength=strength).select("host", "shape", "template", "purity"), "url-templates")
    out = rows.join(judged, ["host", "shape"], "left")
    method = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(page_id), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "template", "purity")
