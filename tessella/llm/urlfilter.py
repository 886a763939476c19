"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Everything here is DataFrame functions. The trees learn from labelled URLs (by default those that the rules decide). Features
are cut into bins at quantiles; labelled URLs with equal bins and label become one weighted row; each level of a
tree is one grouped aggregate of gradients by node, feature and bin, of which the driver picks the splits. A tree
is a CASE expression, so scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import materialise

#: Production parameters. BUCKETS bounds the table of suffix statistics, whatever the number of suffixes; about ROWS labelled
#: URLs, those with the smallest hashes, fit the trees (the suffix statistics are of all).
TREES, DEPTH, RATE, BINS, L2, BUCKETS, ROWS = 10, 3, 0.4, 12, 1.0, 256, 500_000
#: The rules of the query, host with path, and their verdicts.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): after the first `://` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Both are
    empty if the URL is null or has no `://`."""
    text = F.coalesce(F.col(url), F.lit(""))
    found = lambda k: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(found(1), UPPER, LOWER), found(2)


def ruled(host: str, path: str, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains, if the path starts
    with the rule's path. The rules are parameters and become one CASE."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character frequencies; 0 for an empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(share(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def suffix_bucket(host: str) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(F.col(host), ".", -1)), F.lit(BUCKETS)).cast("int")


def lexical(url: str = "url", host: str = "host", path: str = "path") -> dict[str, Column]:
    """Features by name, without the suffix statistics; a null URL counts as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda col, chars: (F.length(col) - F.length(F.translate(col, chars, ""))).cast("double")
    query = F.substring(F.regexp_extract(text, r"(?s)^[^?#]*(\?[^#]*)", 1), 2, 1 << 30)
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(F.col(host)).cast("double"),
        "labels": count(F.col(host), "."),
        "depth": F.size(F.filter(F.split(F.col(path), "/"), lambda x: x != "")).cast("double"),
        "digits": count(text, "0123456789") / n,
        "marks": count(text, "-_.~%+") / n,
        "entropy": entropy(text),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double")),
        "fragment": F.when(text.contains("#"), 1.0).otherwise(0.0),
        "secure": F.when(text.startswith("https"), 1.0).otherwise(0.0),
    }


class Trees:
    """Splits and leaves; `margin` is the expression over columns of binned features."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def add(self, splits: list[list[tuple[str, int] | None]], leaves: list[float]) -> None:
        self.trees.append((splits, leaves))

    def node(self, splits: list, level: int) -> Column:
        """Number of the node of a level that a row falls in."""
        at = F.lit(0)
        for row in splits[:level]:
            right = F.lit(0)
            for i, split in enumerate(row):
                if split:
                    right = F.when(at == i, (F.col(split[0]) > split[1]).cast("int")).otherwise(right)
            at = at * 2 + right
        return at

    def tree(self, splits: list, leaves: list[float], level: int = 0, at: int = 0) -> Column:
        if level == len(splits):
            return F.lit(leaves[at])
        split = splits[level][at]
        left = self.tree(splits, leaves, level + 1, 2 * at)
        return F.when(F.col(split[0]) > split[1], self.tree(splits, leaves, level + 1, 2 * at + 1)).otherwise(left) if split else left

    def margin(self) -> Column:
        return sum((self.tree(*t) for t in self.trees), F.lit(self.base))


class UrlModel:
    """What scoring needs: statistics by suffix bucket, bin edges by feature, trees."""

    def __init__(self, suffixes: dict[int, float], edges: dict[str, list[float]], trees: Trees, prior: float):
        self.suffixes, self.edges, self.trees, self.prior = suffixes, edges, trees, prior

    def features(self) -> dict[str, Column]:
        rate = F.lit(self.prior)
        if self.suffixes:
            table = F.array(*(F.lit(self.suffixes.get(i, self.prior)) for i in range(BUCKETS)))
            rate = F.get(table, suffix_bucket("host"))
        return lexical() | {"suffix": rate}

    def binned(self) -> dict[str, Column]:
        cut = lambda f, edges: sum(((f > e).cast("int") for e in edges), F.lit(0))
        return {f"b_{k}": cut(F.col(f"f_{k}"), e) for k, e in self.edges.items()}

    def prepare(self, urls: DataFrame) -> DataFrame:
        return urls.withColumns({f"f_{k}": f for k, f in self.features().items()}).withColumns(self.binned())

    def score(self) -> Column:
        """Probability of "block" over the columns that `prepare` adds."""
        return 1 / (1 + F.exp(-self.trees.margin()))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = ROWS) -> UrlModel:
    """Fitted on rows of (url, host, path, blocked), blocked being 0 or 1; nulls are left out.

    Of more than `most` rows, those URLs whose hashes lie below a bound for about `most` rows fit the trees; rows of a URL stay
    together, so one that is very frequent is in or out, and weighs as often as it occurs. What reaches the driver is bounded: BUCKETS rates, BINS edges a feature, and sums by node, feature and bin. With no
    rows or one class only, the prior answers alone."""
    rows = labelled.where("blocked is not null").select("url", "host", "path", F.col("blocked").cast("double").alias("y"))
    by = rows.groupBy(suffix_bucket("host").alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    n, y = sum(r.n for r in by), sum(r.y for r in by)
    prior = (y + 1) / (n + 2)
    model = UrlModel({r.k: (r.y + 20 * prior) / (r.n + 20) for r in by}, {}, Trees(math.log(prior / (1 - prior))), prior)
    if not 0 < y < n:
        return model
    names = list(model.features())
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    table = rows.select("y", *(f.alias(f"f_{k}") for k, f in model.features().items()))
    table = materialise(table.groupBy(*table.columns).agg(F.count("*").cast("double").alias("w")), "features")
    places = [i / BINS for i in range(1, BINS)]
    edges = table.agg(*(F.percentile_approx(f"f_{k}", places, 1000).alias(k) for k in names)).first()
    if edges[names[0]] is None:  # the only URLs that there are lie above the bound
        return model
    model.edges = {k: sorted(set(edges[k])) for k in names}
    table = table.withColumns(model.binned())
    bins = [f"b_{k}" for k in names]
    table = materialise(table.groupBy("y", *bins).agg(F.sum("w").alias("w")), "bins")
    for _ in range(trees):
        p = model.score()
        now = table.select(*bins, (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        splits: list[list] = []
        for level in range(depth):
            node = model.trees.node(splits, level)
            each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(b).alias("b")) for i, b in enumerate(bins)))).alias("x")
            sums = now.select(node.alias("node"), "g", "h", each).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            splits.append([best_split([r for r in sums if r.node == i], bins) for i in range(1 << level)])
        found = {r.node: (r.g, r.h) for r in now.groupBy(model.trees.node(splits, depth).alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        model.trees.add(splits, [RATE * found[i][0] / (found[i][1] + L2) if i in found else 0.0 for i in range(1 << depth)])
    return model


def best_split(sums: list, bins: list[str]) -> tuple[str, int] | None:
    """The (column, last bin on the left) with the largest gain, if any gains; ties go to the first."""
    best, found = 1e-9, None
    for f, name in enumerate(bins):
        own = sorted((r.b, r.g, r.h) for r in sums if r.f == f)
        all_g, all_h = sum(g for _, g, _ in own), sum(h for _, _, h in own)
        left_g = left_h = 0.0
        for b, g, h in own[:-1]:
            left_g, left_h = left_g + g, left_h + h
            if min(left_h, all_h - left_h) < 1:
                continue
            gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
            if gain > best + 1e-9:
                best, found = gain, (name, b)
    return found


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict ("allow" or "block") and score (the trees' probability of "block").

    The verdict is the longest fitting rule's, else "block" from a score of 0.5 on. The trees learn from the URLs that rules
    decide. Columns of those names are replaced, others pass through; repeated rows weigh as often as they occur;
    an empty table gives an empty one."""
    host, path = parts(url)
    made = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in urls.columns if c not in made]
    body = urls.select(F.struct(*kept).alias("_row"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled("host", "path", rules)
    body = body.withColumns({"rule": rule, "_ruled": verdict})
    blocked = F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)
    model = fit(body.select("url", "host", "path", blocked.alias("blocked")))
    out = model.prepare(body).withColumn("score", model.score())
    return out.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).select("_row.*", *made)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page, and the trees' score."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4_url_filter: host, path, rule, and the verdict where a rule gives it."""
    found = op4_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


OP4_RULES_SQL = f"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from u),
rules(rule, ruled) as (values {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
fits as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(ruled, length(rule)) as ruled from p join rules
  on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id)
select page_id, host, path, rule, ruled from p left join fits using (page_id)
"""
