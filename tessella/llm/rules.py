"""Quality rules: base limits, and robust multivariate outliers by minimum covariance determinants per language and source.

Everything here is DataFrame functions. The statistics of a document come from array functions over its words. They
are transformed to a vector of four. For every group (language and source) several starts compete: from robust distances by
component, from the covariance of hyperbolic tangents and from that of spatial signs. Concentration steps run as grouped
aggregates by group and start (approximate quantiles of distances, then moments of the nearer part), for all at once;
the start with the smallest determinant goes on until its determinant stops falling, and the estimates are then made once more
from all documents within a usual distance. Mahalanobis distances are columns, by forward substitution through a
Cholesky factor, whose diagonal gives the determinant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import WORD_SPLIT, materialise


def chi_square_quantile(level: float) -> float:
    """The value that a chi-square variable of four degrees of freedom exceeds with probability `level`."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > level else (low, x)
    return low


#: Production parameters. PART of a group's documents, the nearer ones, makes its estimates (CONSISTENCY scales the
#: covariance of that part to that of a normal population, for four dimensions), so that nearly as many may be outliers;
#: STEPS concentration steps from each start, FIRST if STARTS of them compete, then at most MORE from the best one, until no group's log
#: determinant falls by STILL; then documents nearer than all but OUTSIDE of a normal population make the estimates. A group
#: of fewer than SMALLEST documents takes the estimates of its language, or of all.
PART, CONSISTENCY, STEPS, FIRST, STARTS, MORE, STILL, OUTSIDE, SMALLEST = 0.5, 2.109, 3, 2, 3, 8, 0.01, 0.025, 60
#: Share of a normal population beyond the cutoff. It is this small because repeated words have a long tail in clean documents.
LEVEL = 4e-9
CUTOFF = chi_square_quantile(LEVEL)
#: Most that the quartiles' spread may exceed that of the median distances at the start.
STRETCH = 1.5
#: Least variance by component, so that a component that is constant in a group doesn't make every other value an outlier.
#: That of symbols is two a hundred words, so that a group without any rejects a symbol at every third word.
FLOORS = [0.09, 0.01, 0.04, 0.01]
#: Groups whose estimates are broadcast; beyond it they are joined by key, with skewed keys split.
BROADCAST_GROUPS = 20_000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
P = range(4)


def once(column: str, body) -> Column:
    """body(column) with the column bound as a variable: a filter above may be pushed down and bring the column's own
    expression along, which inside a lambda would be evaluated for every element."""
    return F.transform(F.array(F.col(column)), body)[0]


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    A null text has no words. Columns of those names are replaced, all others pass through. A three-word window is known by a 64-bit hash; only texts in which some hash repeats are
    sorted by window, so a text costs n log n at most, whatever its length."""
    row = [c for c in docs.columns if c not in (text, *STATISTICS)]
    body = docs.select(F.struct(*(row or [F.lit(0).alias("_")])).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACE))
    out = body.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT)))
    n = F.size("_words")
    windows = once("_words", lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    out = out.withColumn("_hashes", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))
    same = lambda p, j, x: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
    again = once("_placed", lambda p: F.filter(p, lambda x, j: same(p, j - 1, x) | same(p, j + 1, x)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = out.withColumn("_lines", lines)
    out = out.select(
        *(F.col("_row")[c].alias(c) for c in row),
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_placed").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics: log of the length, log of the mean word length, symbols a word and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.asinh(F.col("n_symbols") / n * 10), F.sqrt(F.col("n_repeat_words") / n)]


def distance(mean: str = "m", factor: str = "l") -> Column:
    """Squared Mahalanobis distance of x0..x3 from m0..m3, by the Cholesky factor l00..l33."""
    y: list[Column] = []
    for i in P:
        rest = F.col(f"x{i}") - F.col(f"{mean}{i}")
        for j in range(i):
            rest = rest - F.col(f"{factor}{i}{j}") * y[j]
        y.append(rest / F.col(f"{factor}{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


MEANS, FACTOR = [f"m{i}" for i in P], [f"l{i}{j}" for i in P for j in range(i + 1)]


def estimates(rows: DataFrame, scale: float, by: tuple[str, ...] = ("_group",)) -> DataFrame:
    """By group: means m0..m3, the Cholesky factor of the covariance, scaled, with floors under its diagonal, and log_det."""
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in P] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in P for j in range(i + 1)]
    out = rows.groupBy(*by).agg(*sums)
    entry = lambda i, j: F.col(f"c{i}{j}") * scale + (FLOORS[i] if i == j else 0.0)
    for i in P:  # a column at a time, so that no expression is repeated
        for j in range(i + 1):
            rest = entry(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] / 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*by, *MEANS, *FACTOR, sum((F.log(f"l{i}{i}") * 2 for i in P), F.lit(0.0)).alias("log_det"))


def few_enough(few: DataFrame) -> bool:
    """Whether a written table with a row a group may be broadcast."""
    return few.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def with_groups(rows: DataFrame, few: DataFrame, by: tuple[str, ...] = ("_group",), small: bool | None = None) -> DataFrame:
    """rows with the columns of their group; few: a row a group, written, broadcast if there are at most BROADCAST_GROUPS
    (small: already known)."""
    small = few_enough(few) if small is None else small
    return rows.join(F.broadcast(few) if small else few, list(by))


def concentrated(sample: DataFrame, middle: DataFrame, small: bool, by: tuple[str, ...] = ("_group",)) -> DataFrame:
    """One concentration step: the estimates of the part of each group that lies nearest by the estimates given."""
    measured = with_groups(sample, middle, by, small).select(*by, *MEANS, *FACTOR, distance().alias("d"))
    limit = measured.groupBy(*by).agg(F.percentile_approx("d", PART, 10_000).alias("limit"), *(F.first(c).alias(c) for c in (*MEANS, *FACTOR)))
    limit = materialise(limit, "limits", small=True)
    return materialise(estimates(with_groups(sample, limit, by, small).where(distance() <= F.col("limit")).select(*by, *(f"x{i}" for i in P)), CONSISTENCY, by), "estimates", small=True)


def group_key(*columns: Column) -> Column:
    return F.to_json(F.struct(F.lit(len(columns)).alias("level"), *columns))


def fit(stats: DataFrame, lang: str = "lang", source: str = "source", starts: int = 1, more: int = 0, outside: float | None = None) -> DataFrame:
    """A row for each group: _group and its estimates, or those of its language or of all if it is small.

    By default STEPS steps from robust distances alone; `production_fit` lets STARTS starts compete and goes on to the
    smallest determinant. Groups are the values of language and source, null being a value. Documents that fail the base rules take no part in the
    estimates. Groups of any size are aggregated in part before a shuffle. Ties and repeated rows count as they are;
    an empty table gives no estimates. stats is read several times: a written table."""
    x, key = vector(), group_key
    good = stats.where(~F.col("base_failed")).select(F.col(lang), F.col(source), *(x[i].alias(f"x{i}") for i in P))
    lang_, both = F.col(lang).alias("lang"), (F.col(lang).alias("lang"), F.col(source).alias("source"))
    pairs = good.groupBy(key(*both).alias("_pair"), key(lang_).alias("_lang")).agg(F.count("*").alias("n"))
    langs = pairs.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    chosen = pairs.join(langs, "_lang").select(F.col("_pair").alias("_group"), F.when(F.col("n") >= SMALLEST, F.col("_pair")).when(F.col("n_lang") >= SMALLEST, F.col("_lang")).otherwise(key()).alias("_to"))
    chosen = materialise(chosen, "groups", small=True)
    placed = with_groups(good.withColumn("_group", key(*both)), chosen).drop("_group").withColumnRenamed("_to", "_group")
    placed = placed.select("_group", *(f"x{i}" for i in P))
    # groups that lend their estimates are made of all documents below them
    lent = good.select(key(lang_).alias("_group"), *(f"x{i}" for i in P)).unionByName(good.select(key().alias("_group"), *(f"x{i}" for i in P)))
    needed = materialise(chosen.select(F.col("_to").alias("_group")).distinct(), "needed", small=True)
    own = placed.where(~F.col("_group").startswith('{"level":1') & ~F.col("_group").startswith('{"level":0'))
    small = few_enough(chosen)
    sample = materialise(own.unionByName(with_groups(lent, needed, small=small)), "samples")
    # robust distances by component. The quartiles' distance gives the spread, unless outliers on one side (more than a
    # quarter) stretch it far beyond the median distance from the median, which fewer than half can't move
    centre = sample.groupBy("_group").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in P))
    centre = materialise(centre.select("_group", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in P), *((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]).alias(f"w{i}") for i in P)), "centres", small=True)
    away = with_groups(sample, centre, small=small).groupBy("_group").agg(*(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in P))
    spread = [F.greatest(F.least(F.col(f"w{i}") / 1.349, F.col(f"a{i}") * 1.4826 * STRETCH), F.lit(FLOORS[i] ** 0.5)).alias(f"s{i}") for i in P]
    centre = materialise(centre.join(away, "_group").select("_group", *MEANS, *spread), "spreads", small=True)
    both_keys = ("_group", "start")
    first = centre.select("_group", F.lit(0).alias("start"), *MEANS, *(F.col(f"s{i}") if i == j else F.lit(0.0) for i in P for j in range(i + 1))).toDF(*both_keys, *MEANS, *FACTOR)
    middle, sampled = materialise(first, "starts", small=True), sample.withColumn("start", F.lit(0))
    if starts > 1:
        z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in P]
        norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
        curbed = F.struct(F.lit(1).alias("start"), *((F.col(f"s{i}") * F.tanh(z[i])).alias(f"x{i}") for i in P))
        signs = F.struct(F.lit(2).alias("start"), *(F.when(norm > 0, F.col(f"s{i}") * 2 * z[i] / norm).otherwise(0.0).alias(f"x{i}") for i in P))
        shapes = with_groups(sample, centre, small=small).select("_group", F.explode(F.array(*[curbed, signs][: starts - 1])).alias("v")).select("_group", "v.*")
        others = estimates(shapes, 1.0, both_keys).drop(*MEANS, "log_det").join(centre.select("_group", *MEANS), "_group").select(*both_keys, *MEANS, *FACTOR)
        middle = materialise(middle.unionByName(others), "starts", small=True)
        sampled = sample.withColumn("start", F.explode(F.array(*(F.lit(k) for k in range(starts)))))
    for _ in range(STEPS if starts == 1 else FIRST):
        middle = concentrated(sampled, middle, small, both_keys)
    names = [*MEANS, *FACTOR, "log_det"]
    if starts > 1:
        best = middle.groupBy("_group").agg(F.min(F.struct("log_det", "start", *MEANS, *FACTOR)).alias("b"))
        middle = materialise(best.select("_group", *(F.col(f"b.{c}") for c in names)), "estimates", small=True)
    for _ in range(more):
        after = concentrated(sample, middle, small)
        both = after.select("_group", *names, F.lit(True).alias("new")).unionByName(middle.select("_group", *names, F.lit(False).alias("new")))
        of = lambda new: F.max(F.when(F.col("new") == new, F.col("log_det")))
        # a group that has come to rest keeps its estimates
        lower = both.groupBy("_group").agg(F.min(F.struct("log_det", *MEANS, *FACTOR)).alias("b"), (of(False) - of(True)).alias("fell"))
        middle = materialise(lower.select("_group", *(F.col(f"b.{c}") for c in names), "fell"), "estimates", small=True)
        if middle.where(F.col("fell") > STILL).isEmpty():
            break
    if outside:
        measured = with_groups(sample, middle, small=small).select("_group", *(f"x{i}" for i in P), distance().alias("d"))
        middle = materialise(estimates(measured.where(F.col("d") <= chi_square_quantile(outside)), 1.0), "estimates", small=True)
    return materialise(chosen.join(middle.select(F.col("_group").alias("_to"), *MEANS, *FACTOR), "_to").drop("_to"), "estimates", small=True)


def production_fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    return fit(stats, lang, source, STARTS, MORE, OUTSIDE)


def judge(stats: DataFrame, groups: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """stats with distance (null if base_failed) and kept: not base_failed and not farther than `cutoff`. Columns of those
    names are replaced, all others pass through."""
    x, row = vector(), F.struct(*(c for c in stats.columns if c not in ("distance", "kept"))).alias("_row")
    good = stats.where(~F.col("base_failed")).select(row, group_key(F.col(lang).alias("lang"), F.col(source).alias("source")).alias("_group"), *(x[i].alias(f"x{i}") for i in P))
    kept = with_groups(good, groups).select("_row", distance().alias("distance"))
    failed = stats.where("base_failed").select(row, F.lit(None).cast("double").alias("distance"))
    return kept.unionByName(failed).select("_row.*", "distance", (~F.col("_row.base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject, all columns as they are. The rows are written once with their statistics."""
    rows = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    stats = materialise(statistics(rows), "stats")
    return judge(stats.where(~F.col("base_failed")), production_fit(stats.drop("_row"))).where("kept").select("_row.*")


RESULT = ["doc_id", *STATISTICS, "kept"]


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and its distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    stats = materialise(statistics(docs), "stats")
    return judge(stats, production_fit(stats)).select(*RESULT, "distance")


def op9_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality_rules that SQL can express."""
    return op9_quality_rules(spark, sf_dir).select(*RESULT[:-1])


OP9_BASE_SQL = """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
windows as (select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select r, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2)),
again as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from windows) where n > 1),
covered as (select r, count(distinct i + k) as n from again cross join range(3) s(k) group by r),
counted as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join covered using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
"""
