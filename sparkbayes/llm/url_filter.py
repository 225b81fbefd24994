"""URL verdicts from a path-template tree (operator 2); DataFrame functions only.

Each path becomes a shape: runs of digits and long hexadecimal words are variable on sight, slashes at the end fall away.
The shapes of a host, counted, form a tree of segments. Top down, at every node, a segment that fewer than ``least``
pages have becomes a wildcard, every other one is a branch, and siblings whose labelled block rates don't differ
significantly (two-proportion z between a branch and the group so far, in order of rate) become one branch; one without
labels stays alone. A branch of a single shape is a leaf, and so are the ends of paths; wildcards below ``depth`` take the
rest of the path with them. A leaf's path from the root is a template.

A template's purity is the block rate of its host's labelled pages that have it, smoothed towards what the same shapes
say of all hosts together: a shape's block rate over all hosts, smoothed towards that of the shape one segment
shorter, and so on up to the rate of all labelled pages. Templates at or above ``reject`` are blocked. Labels are what
the rules say of the pages they cover, or ``label`` where given.

The tree holds one row per host and shape and is written to the shared folder level by level, so plans stay small.
The pages meet it in one join on (host, shape), which Spark splits where one of them holds many of the rows.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and the verdict of that template
like any other; an url of any length is judged whole (its shape's rate backs off by the first ``depth`` segments, then
the rest at once); equal urls get equal verdicts; ties between rules go to the last by name; without any label every
purity is one half; an empty table gives an empty table; other columns pass through unless named like a result, which
replaces them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: (host, path, verdict)
Rule = tuple[str, str, str]

RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for at, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path's segments with what varies on sight generalised, without slashes at the end."""
    plain = F.regexp_replace(F.regexp_replace(path, "(?i)\\b(?=[a-f]*[0-9])[0-9a-f]{12,}\\b", "<hex>"), "[0-9]+", "<n>")
    return F.regexp_replace(plain, "/+$", "")


def pooled(shapes: DataFrame, depth: int, weight: float) -> DataFrame:
    """(shape, prior): each shape's block rate over all hosts, smoothed towards that of the shape one segment shorter, up to all pages."""
    alike = shapes.groupBy("shape").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    parts = F.split("shape", "/")
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth + 1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix")))
    whole = F.when(F.size(parts) > depth + 1, F.array(F.struct(F.lit(depth + 2).alias("k"), F.col("shape").alias("prefix")))).otherwise(F.array().cast("array<struct<k:int,prefix:string>>"))
    steps = alike.select("shape", "labelled", "blocked", F.explode(F.concat(upto, whole)).alias("s")).select("shape", "labelled", "blocked", "s.k", "s.prefix")
    sums = steps.groupBy("prefix", "k").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"))
    ladder = steps.select("shape", "k", "prefix").join(sums, ["prefix", "k"]).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("k", "m", "b"))).alias("steps"))  # at most depth + 2
    rate = F.aggregate("steps", F.lit(0.5), lambda above, s: (s["b"] + weight * above) / (s["m"] + weight))
    return ladder.select("shape", rate.alias("prior"))


def merged(branches: DataFrame, z: float, weight: float) -> DataFrame:
    """(host, template, _r, _size) with the ``_branch`` of labelled branches that are alike.

    Siblings are first added up by rate and size, so that a node has at most some thousand classes however many
    segments it has. In order of rate, a class joins the group before it unless one branch of its size, smoothed
    towards the prior, differs significantly from the whole group.
    """
    classes = branches.where("_r IS NOT NULL").groupBy("host", "template", "_r", "_size").agg(
        F.count(F.lit(1)).alias("k"), F.sum("labelled").cast("double").alias("m"), F.sum("blocked").cast("double").alias("b"), F.avg("prior").alias("p"), F.min("seg").alias("first"), F.max("seg").alias("last")
    )
    ordered = classes.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("_r", "_size", "k", "m", "b", "p", "first", "last"))).alias("all"))

    def step(acc: Column, c: Column) -> Column:
        b1, m1 = c["b"] / c["k"] + weight * c["p"], c["m"] / c["k"] + weight
        b0, m0 = acc["b"] + weight * c["p"], acc["m"] + weight
        both = (b0 + b1) / (m0 + m1)
        apart = F.abs(b1 / m1 - b0 / m0) > z * F.sqrt(both * (1 - both) * (1 / m0 + 1 / m1))
        new = (acc["m"] > 0) & apart
        g = acc["g"] + new.cast("int")
        return F.struct(F.when(new, c["b"]).otherwise(acc["b"] + c["b"]).alias("b"), F.when(new, c["m"]).otherwise(acc["m"] + c["m"]).alias("m"), g.alias("g"), F.concat(acc["gs"], F.array(g)).alias("gs"))

    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("m"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("gs"))
    grouped = ordered.withColumn("gs", F.aggregate("all", start, step, lambda acc: acc["gs"])).withColumn("zipped", F.arrays_zip("all", "gs"))

    def call(x: Column) -> Column:
        alike = F.transform(F.filter("zipped", lambda y: y["gs"] == x["gs"]), lambda y: y["all"])
        k = F.aggregate(alike, F.lit(0).cast("long"), lambda n, y: n + y["k"])
        first, last = F.array_min(F.transform(alike, lambda y: y["first"])), F.array_max(F.transform(alike, lambda y: y["last"]))
        name = F.when(k == 1, first).when(k == 2, F.concat(F.lit("("), first, F.lit("|"), last, F.lit(")"))).otherwise(F.concat(F.lit("("), first, F.lit("|+"), (k - 1).cast("string"), F.lit(")")))
        return F.struct(x["all"]["_r"].alias("_r"), x["all"]["_size"].alias("_size"), name.alias("_branch"))

    return grouped.select("host", "template", F.explode(F.transform("zipped", call)).alias("x")).select("host", "template", "x._r", "x._size", "x._branch")


def grow(shapes: DataFrame, depth: int, least: int, z: float, weight: float) -> DataFrame:
    """(host, shape, n, labelled, blocked, prior) with the ``template`` of each row."""
    node, given = ["host", "template"], shapes.columns
    parts = F.split("shape", "/")
    at, done, level = shapes.withColumn("template", F.element_at(parts, 1)), [], 0
    while True:
        level += 1
        done.append(at.where(F.size(parts) <= level).select(*given, "template"))
        going = at.where(F.size(parts) > level).withColumn("seg", F.get(parts, F.lit(level)))
        if going.isEmpty():
            break
        # What speaks for a segment: pages, labels, and whether more than one shape goes through it.
        branches = going.groupBy(*node, "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], (F.sum(F.col("n") * F.col("prior")) / F.sum("n")).alias("prior"), F.count(F.lit(1)).alias("k"))
        own = (F.col("n") >= least) | F.col("seg").isin("<n>", "<hex>")
        known = own & (F.col("labelled") > 0)
        rate = (F.col("blocked") + weight * F.col("prior")) / (F.col("labelled") + weight)
        branches = branches.withColumn("own", own).withColumn("_r", F.when(known, F.round(100 * rate).cast("int"))).withColumn("_size", F.when(known, F.floor(F.log2("labelled")).cast("int")))
        branches = stored(branches, f"url-branches-{level}")
        to = branches.join(merged(branches, z, weight), [*node, "_r", "_size"], "left")
        to = to.select(*node, "seg", "own", "k", F.coalesce("_branch", F.when(F.col("own"), F.col("seg")).otherwise(F.lit("*"))).alias("_to"))
        moved = going.join(to, [*node, "seg"])
        tail = F.concat(F.lit("/"), F.array_join(F.slice(parts, level + 2, F.greatest(F.size(parts) - level - 1, F.lit(0))), "/"))
        more = F.size(parts) > level + 1
        single, lost = F.col("own") & (F.col("k") == 1), ~F.col("own") & F.lit(level >= depth)
        leaf = F.when(lost, F.lit("*")).otherwise(F.concat("_to", F.when(more, tail).otherwise(F.lit(""))))
        moved = moved.withColumn("template", F.concat("template", F.lit("/"), F.when(single | lost, leaf).otherwise(F.col("_to")))).withColumn("_leaf", single | lost)
        at, before = stored(moved.select(*given, "template", "_leaf"), f"url-tree-{level}"), branches
        discard(before)
        done.append(at.where("_leaf").select(*given, "template"))
        at = at.where("NOT _leaf").select(*given, "template")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def judge(
    pages: DataFrame,
    url: str = "url",
    *,
    rules: list[Rule] = RULES,
    label: str | None = None,
    depth: int = 8,
    least: int = 3,
    z: float = 1.96,
    weight: float = 4.0,
    reject: float = 0.75,
) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict.

    depth: levels down to which wildcards are followed, and segments by which a shape's rate backs off. least: number of
    pages that a named branch has. z: standard errors below which branches are alike. weight: labels that a prior counts
    as. reject: least purity of a blocked template.
    """
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    rows = pages.select(*[c for c in pages.columns if c not in made], F.col(url).alias("_url"))
    host, path = host_path(F.col("_url"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_says", says).withColumn("shape", shape(F.col("path")))
    known = F.col("_says") if label is None else F.coalesce("_says", label)
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(known).alias("labelled"), F.count(F.when(known == "block", 1)).alias("blocked"))
    counted = stored(shapes, "url-shapes")
    shapes = stored(counted.join(pooled(counted, depth, weight), "shape"), "url-priors")
    discard(counted)
    grown = stored(grow(shapes, depth, least, z, weight), "url-templates")
    discard(shapes)
    prior = F.sum(F.col("n") * F.col("prior")) / F.sum("n")
    templates = grown.groupBy("host", "template").agg(((F.sum("blocked") + weight * prior) / (F.sum("labelled") + weight)).alias("purity"))
    scored = stored(grown.select("host", "shape", "template").join(templates, ["host", "template"]), "url-purities")
    discard(grown)
    out = rows.join(scored, ["host", "shape"], "left")
    verdict = F.coalesce(F.col("_says"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    columns = [c for c in rows.columns if c not in ("_url", "_says", "shape", *made)]
    return out.select(*columns, "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
