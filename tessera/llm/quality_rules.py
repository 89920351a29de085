"""Quality rules: base rules and robust multivariate outliers, in DataFrame functions only.

Each text is read once, into a narrow row of counts. Rows that pass the base rules give transformed statistic vectors.
Minimum-covariance-determinant estimates are fitted per language and source, per language, and over all: concentration
steps from two starts (all rows; medians with MAD scales) run until no determinant moves, the start with the smaller one
wins, and one reweighting step follows. Each estimate is then shrunk towards its parent's as if SHRINK rows
came from there, so a small group's verdicts move smoothly from its parent's to its own; no group is left out, whatever
its size. A row is rejected when its squared Mahalanobis distance exceeds `cutoff`, a chi-squared quantile. Quantiles of
the distances come from mergeable sketches (exact within 1/10,000 of a group's rows) and moments from partial
aggregation, so a hot source is as cheap as any. A step is one query over the narrow rows, and what it carries on is one
row a group and start.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, documents, id_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The transformed statistics and the least standard deviation that each is taken to have.
SCALES = {"word_length": 0.08, "symbols": 0.25, "dup_lines": 0.4, "repeats": 0.4, "length": 1.0}


def chi_squared_tail(x: float, degrees: int) -> float:
    """P(X > x), for an odd number of degrees."""
    tail, term = math.erfc(math.sqrt(x / 2)), math.exp(-x / 2) * math.sqrt(2 * x / math.pi)
    for k in range(3, degrees + 1, 2):
        tail, term = tail + term, term * x / k
    return tail


def chi_squared_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1_000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_tail(middle, degrees) > tail else (low, middle)
    return high


P = len(SCALES)
#: Share of rows in the covariance subset (half: the estimate stands up to as much junk), and the factor that makes its
#: covariance consistent for Gaussian rows.
CORE = 0.5
CORE_FACTOR = CORE / (1 - chi_squared_tail(chi_squared_quantile(1 - CORE, P), P + 2))
#: Squared distance within which rows count in the reweighting step.
REWEIGHT = chi_squared_quantile(0.025, P)
#: Share of Gaussian rows that are rejected by mistake, and the squared distance that it means (about 40).
MISTAKES = 1.5e-7
CUTOFF = chi_squared_quantile(MISTAKES, P)
#: All covariances have this much added on the diagonal, in units of SCALES: no group counts as tighter than the least
#: standard deviations there, not even one whose rows are all alike.
RIDGE = 1.0
#: Rows that a parent's estimate counts for.
SHRINK = 60
#: Concentration steps go on until no log-determinant moves by more than STILL, or for STEPS steps.
STILL, STEPS = 1e-3, 30
#: Narrow rows that a task of the fit should have at least.
TASK_ROWS = 25_000
#: Groups that a task of what there is once a group should have at least: many partitions would be files of a row each.
TASK_GROUPS = 8
#: Groups whose parameters are broadcast (about 200 bytes each), and salts of a hot group beyond it.
BROADCAST_GROUPS = 50_000
SALTS = 32


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text; windows are compared by 64-bit hash."""
    hashes = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        gap = lambda k: F.when(k + 1 < F.size(at), F.least(F.lit(3), F.get(at, k + 1) - F.get(at, k))).otherwise(3)
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda a, k: a + gap(k))

    def sorted_positions(h: Column) -> Column:
        """Positions of repeated hashes, by one sort of (hash, position)."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, k, j: F.get(p, j)["h"].eqNullSafe(F.get(p, k)["h"])
        keep = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: same(p, k, k + 1) | ((k > 0) & same(p, k, F.greatest(k - 1, F.lit(0)))))
        return _let(pairs, lambda p: F.array_sort(F.transform(keep(p), lambda k: F.get(p, k)["i"])))

    def few_positions(h: Column, dup: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(dup, x), i)), lambda i: i.isNotNull())

    def count(h: Column) -> Column:
        twice = _let(F.array_sort(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0))) == x))))
        some = lambda d: _let(F.when(F.size(d) <= 64, few_positions(h, d)).otherwise(sorted_positions(h)), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(twice, some))

    return _let(hashes, count)


def statistics(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each row; null text has no words."""
    base = docs.select(id_of().alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), *key)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))
    return base.select("doc_id", *key, "lang", "source", of_words.alias("w"), of_lines.alias("l"), symbols.cast("long").alias("n_symbols")).select("doc_id", *key, "lang", "source", "w.*", "l.*", "n_symbols")


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, m, by: F.log1p(m * F.col(c) / by)
    values = {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": share("n_symbols", 20, n),
        "dup_lines": share("n_dup_lines", 10, F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": share("n_repeat_words", 10, n),
        "length": F.log(n),
    }
    return stats.select("*", *[(values[k] / s).alias(f"x{i}") for i, (k, s) in enumerate(SCALES.items())])


def _joined(rows: DataFrame, params: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with the parameters of their group; few: whether there are at most BROADCAST_GROUPS groups.

    Few groups go to the rows, which then need no exchange before they are aggregated in part. Otherwise both sides are
    dealt by group and one of SALTS numbers, so that a hot group is spread over as many tasks.
    """
    if few:
        return rows.join(F.broadcast(params), on, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    spread = params.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def _cut_groups(params: DataFrame, groups: int) -> DataFrame:
    """params, rows of so many groups, written by as few tasks as TASK_GROUPS says."""
    return cut(params.coalesce(max(1, -(-groups // TASK_GROUPS))))


X = [f"x{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments(rows: DataFrame, *by) -> DataFrame:
    """n, means m* and covariances c** (lower triangle) of each group; by: columns to group by, and further aggregates."""
    keys, more = [k for k in by if isinstance(k, str)], [k for k in by if not isinstance(k, str)]
    sums = [F.expr(f"avg(x{i}) AS m{i}") for i in range(P)] + [F.expr(f"avg(x{i} * x{j}) AS c{i}{j}") for i, j in LOWER]
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), *more, *sums)
    return got.selectExpr(*[c for c in got.columns if c[0] != "c"], *[f"c{i}{j} - m{i} * m{j} AS c{i}{j}" for i, j in LOWER])


def _inverse(matrix: Column) -> Column:
    """p (inverse) and det (log-determinant) of a positive definite matrix, an array by rows, by the sweep operator."""
    kind = "struct<p:array<double>,det:double>"

    def sweep(a: Column, k: Column) -> Column:
        pivot = F.get(a["p"], k * (P + 1))

        def cell(x: Column, ij: Column) -> Column:
            i, j = F.floor(ij / P).cast("int"), F.pmod(ij, F.lit(P))
            whole = F.when(j == k, -1 / pivot).otherwise(x / pivot)
            return F.when(i == k, whole).when(j == k, x / pivot).otherwise(x - F.get(a["p"], i * P + k) * F.get(a["p"], k * P + j) / pivot)

        return F.struct(F.transform(a["p"], cell).alias("p"), (a["det"] + F.log(pivot)).alias("det")).cast(kind)

    start = F.struct(matrix.alias("p"), F.lit(0.0).alias("det")).cast(kind)
    swept = F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), start, sweep)
    return F.struct(F.transform(swept["p"], lambda x: -x).alias("p"), swept["det"].alias("det"))


def _params(moments: DataFrame, factor: float, inverse: Column, *keep: str) -> DataFrame:
    """keep, m (means), p (inverse) and det of factor * covariance + RIDGE; inverse: that of the column `matrix`."""
    cells = [f"{factor!r}D * c{max(i, j)}{min(i, j)} + {RIDGE if i == j else 0.0!r}D" for i in range(P) for j in range(P)]
    means = ", ".join(f"m{i}" for i in range(P))
    got = moments.selectExpr(*keep, f"array({means}) AS m", f"array({', '.join(cells)}) AS matrix")
    return got.select(*keep, "m", inverse.alias("inverse")).select(*keep, "m", "inverse.*")


def _far(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """rows, with d, the squared Mahalanobis distance under each parameter row of their group."""
    got = _joined(rows, params, ["grp"], few)
    got = got.selectExpr("*", *[f"x{i} - get(m, {i}) AS z{i}" for i in range(P)])
    d = " + ".join(f"get(p, {i * P + j}) * z{i} * z{j} * {1 if i == j else 2}.0D" for i, j in LOWER)
    return got.selectExpr(*[c for c in got.columns if c not in ("m", "p") and c[0] != "z"], f"{d} AS d")


def mcd_moments(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """n, means m* and covariances c** of the estimate of each grp; rows: grp, x0..x4, a written table."""
    by = ["grp", "start"]
    inverse = _inverse(F.col("matrix"))
    everything = _params(_moments(rows, "grp"), 1.0, inverse, "grp")
    middle = cut(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(X)]))
    groups = middle.count()
    few = groups <= BROADCAST_GROUPS
    scale = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10_000).alias(f"s{i}") for i, x in enumerate(X)]
    spread = _joined(rows, middle, ["grp"], few).groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *scale)
    robust = _params(spread.select("*", *[(F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in LOWER]), 1.0, inverse, "grp")
    one = lambda df, k: df.select("grp", F.lit(k).alias("start"), "m", "p", "det")
    params = _cut_groups(one(everything, 0).unionByName(one(robust, 1)), groups)
    for _ in range(steps):
        limits = _far(rows, params, few).groupBy(*by).agg(F.percentile_approx("d", CORE, 10_000).alias("top"))
        core = _far(rows, params.join(limits, by), few).where("d <= top")
        params = _cut_groups(_params(_moments(core, *by, F.max("det").alias("was")), CORE_FACTOR, inverse, *by, "was"), groups)
        moved = params.agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        if moved is None or moved <= STILL:
            break
    best = _cut_groups(params.groupBy("grp").agg(F.min_by(F.struct("m", "p"), "det").alias("best")).select("grp", "best.*"), groups)
    return _cut_groups(_moments(_far(rows, best, few).where(F.col("d") <= REWEIGHT), "grp"), groups)


def _factor(moments: DataFrame, s: str) -> DataFrame:
    """grp, centre m* and Cholesky factor l** of covariance + RIDGE, as columns with suffix s."""
    out = moments
    for i, j in LOWER:
        a = F.col(f"c{i}{j}") + (RIDGE if i == j else 0.0)
        a = reduce(lambda x, k: x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), a)  # noqa: B023
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(a, F.lit(1e-9))) if i == j else a / F.col(f"l{j}{j}"))
    return out.select("grp", *[F.col(f"m{i}").alias(f"m{i}{s}") for i in range(P)], *[F.col(f"l{i}{j}").alias(f"l{i}{j}{s}") for i, j in LOWER])


def _distance(rows: DataFrame, s: str) -> DataFrame:
    """rows with d<s>, the squared Mahalanobis distance under the parameters with suffix s."""
    for i in range(P):
        left = reduce(lambda x, k: x - F.col(f"l{i}{k}{s}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}{s}"))  # noqa: B023
        rows = rows.withColumn(f"z{i}", left / F.col(f"l{i}{i}{s}"))
    return rows.withColumn(f"d{s}", reduce(lambda x, y: x + y, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)])).drop(*[f"z{i}" for i in range(P)])


def mcd_distances(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """grp and the parameters (suffix _f) of its own estimate; rows: grp, x0..x4, a written table."""
    return cut(_factor(mcd_moments(rows, steps), "_f"))


def _shrunk(own: DataFrame, parents: DataFrame) -> DataFrame:
    """own (grp, up, n, m*, c**) moved towards the moments of the parent named up, which counts for SHRINK rows."""
    names = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in LOWER]
    both = own.join(parents.select(F.col("grp").alias("up"), *[F.col(c).alias(f"up_{c}") for c in names]), "up")
    w = F.col("n") / (F.col("n") + SHRINK)
    mean = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"up_m{i}")).alias(f"m{i}") for i in range(P)]
    gap = lambda i: F.col(f"m{i}") - F.col(f"up_m{i}")
    spread = [(w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"up_c{i}{j}") + w * (1 - w) * gap(i) * gap(j)).alias(f"c{i}{j}") for i, j in LOWER]
    return both.select("grp", "n", *mean, *spread)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, key: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, key (columns of docs), the statistics, base_failed, distance2 (null if base_failed), kept.

    Null lang and source are groups of their own (the empty string). An empty table gives no rows; repeated rows, ties
    and rows that share an id each get the verdict of their own text. Texts of any length are read whole.
    """
    stats = statistics(docs, key)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = cut(_vectors(stats.withColumn("base_failed", failed)).withColumn("grp", F.concat_ws("\u0001", F.lit("own"), "lang", "source")))
    fit = stats.where(~F.col("base_failed"))
    levels = F.array(F.col("grp"), F.concat_ws("\u0001", F.lit("lang"), "lang"), F.lit("all"))
    tasks = max(1, -(-3 * fit.count() // TASK_ROWS))
    rows = cut(fit.select(F.explode(levels).alias("grp"), *X).coalesce(tasks))
    moments = mcd_moments(rows)
    top = moments.where("grp = 'all'").drop("n")
    up = F.concat_ws("\u0001", F.lit("lang"), F.get(F.split("grp", "\u0001"), F.lit(1)))
    languages = _shrunk(moments.where(F.col("grp").startswith("lang\u0001")).withColumn("up", F.lit("all")), top)
    own = _shrunk(moments.where(F.col("grp").startswith("own\u0001")).withColumn("up", up), languages)
    params = _cut_groups(_factor(own, "_f"), moments.count())
    judged = _distance(_joined(stats, params, ["grp"], params.count() <= BROADCAST_GROUPS, "left"), "_f").withColumn("distance2", F.when(~F.col("base_failed"), F.col("d_f")))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", *key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance2", 3).alias("distance2"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
