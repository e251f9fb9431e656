"""Mergeable statistics, evaluation measures and trend tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.prefix import numbered, running
from tessera.plans.session import table

ROUND = 6


def r(c: Column, digits: int = ROUND) -> Column:
    return F.round(c, digits)


def running_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, sum, mean, extremes, sample variance and deviation, bias-corrected skewness and excess kurtosis; one mergeable aggregation."""
    v, n = F.col(value), F.count(value).cast("double")
    g1 = F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, ((n + 1) * F.kurtosis(v) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), r(F.sum(v), 2).alias("total"), r(F.avg(v)).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        r(F.var_samp(v), 4).alias("variance"), r(F.stddev_samp(v)).alias("stddev"), r(g1).alias("skew"), r(g2).alias("ex_kurtosis"),
    )


def covariance(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pairwise statistics of two columns: covariance, correlation, R squared, mean squared error, share of equal signs (0 is positive)."""
    return df.groupBy(*by).agg(
        r(F.covar_samp(x, y), 4).alias("cov"), r(F.corr(x, y)).alias("corr"), r(F.corr(x, y) * F.corr(x, y)).alias("r_squared"),
        r(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))), 3).alias("mse"), r(F.avg(F.when((F.col(x) >= 0) == (F.col(y) >= 0), 1.0).otherwise(0.0))).alias("sign_agreement"),
    )


def decayed_stats(df: DataFrame, by: str, order: list[str], value: str, half_life: float) -> DataFrame:
    """Exponentially forgotten mean and variance: the weight of a value halves every half_life values after it."""
    back = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    w = F.pow(F.lit(0.5), (F.row_number().over(back) - 1) / F.lit(float(half_life)))
    x = df.select(by, F.col(value).alias("v"), w.alias("w"))
    return x.groupBy(by).agg(
        F.count("*").alias("n"), r(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 5).alias("mean"),
        r(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w") - F.pow(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 2)), 4).alias("variance"),
    )


def cross_covariance(df: DataFrame, by: list[str], left: list[str], right: list[str]) -> DataFrame:
    """(by, x, y, cov) of every column of one vector with every column of another; one mergeable aggregation."""
    pairs = [(x, y) for x in left for y in right]
    wide = df.groupBy(*by).agg(*[F.covar_samp(x, y).alias(f"_{k}") for k, (x, y) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), (r(F.col(f"_{k}"), 5) + 0.0).alias("cov")) for k, (x, y) in enumerate(pairs)])
    return wide.select(*by, F.explode(cells).alias("e")).select(*by, "e.*")


def decayed_covariance(df: DataFrame, by: str, order: list[str], x: str, y: str, half_life: float) -> DataFrame:
    """Covariance and correlation of two columns under weights that halve every half_life values; null unless the weights pass 1."""
    back = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    w = F.pow(F.lit(0.5), (F.row_number().over(back) - 1) / F.lit(float(half_life)))
    a, b = F.col("w") * F.col("x"), F.col("w") * F.col("y")
    sums = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).groupBy(by)
    s = sums.agg(F.sum("w").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * F.col("x")).alias("xx"), F.sum(b * F.col("y")).alias("yy"), F.sum(a * F.col("y")).alias("xy"))
    n = F.col("n")
    cov, vx, vy = F.col("xy") - F.col("x") * F.col("y") / n, F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    return s.select(by, r(F.when(n > 1, cov / (n - 1)), 4).alias("cov"), r(F.when(n > 1, F.try_divide(cov, F.sqrt(vx * vy))), 5).alias("corr"))


def roc(df: DataFrame, score: str, truth: str, ties: list[str]) -> DataFrame:
    """One point an item by falling score, false items first at equal scores: running shares of true and false items."""
    flag = F.col(truth).cast("int").cast("long")
    order = [F.desc(score), F.asc(truth), *map(F.asc, ties)]
    totals = df.agg(F.sum(flag).alias("p"), F.sum(1 - flag).alias("q"))
    sums = running(df, order, {"tp": flag, "fp": 1 - flag})
    return sums.crossJoin(F.broadcast(totals)).select(  # one row of totals
        *ties, F.col(score).alias("threshold"), r(F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))).alias("tpr"), r(F.coalesce(F.try_divide("fp", "q"), F.lit(0.0))).alias("fpr")
    )


def equal_error_rate(df: DataFrame, score: str, high: str, ties: list[str]) -> DataFrame:
    """Where the shares of missed high values and of accepted low values differ least, walking down the ROC points; the first such point.

    Without low values the rate is 0 at the smallest high value, without high values 0 at the largest low value plus 1, without any 0 at 0.
    """
    flag = F.col(high).cast("int").cast("long")
    totals = df.agg(F.sum(flag).alias("p"), F.sum(1 - flag).alias("q"), F.min(F.when(F.col(high), F.col(score))).alias("least"), F.max(F.when(~F.col(high), F.col(score))).alias("most"))
    sums = running(df, [F.desc(score), F.asc(high), *map(F.asc, ties)], {"tp": flag, "fp": 1 - flag, "rn": F.lit(1).cast("long")})
    own = sums.crossJoin(F.broadcast(totals)).select("rn", F.col(score).alias("threshold"), (1 - F.try_divide("tp", "p")).alias("fnr"), F.try_divide("fp", "q").alias("fpr"))
    best = own.agg(F.min(F.struct(r(F.abs(F.col("fnr") - F.col("fpr")), 12).alias("d"), "rn", F.greatest("fnr", "fpr").alias("rate"), "threshold")).alias("b"))
    one_sided = F.coalesce(F.col("least"), F.col("most") + 1, F.lit(0.0))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return best.crossJoin(F.broadcast(totals)).select(
        F.when(both, r(F.col("b.rate"))).otherwise(0.0).alias("rate"), F.when(both, F.col("b.threshold")).otherwise(one_sided).alias("threshold")
    )


def average_precision(df: DataFrame, by: str, order: list[Column], relevant: Column, missing: int = 0) -> DataFrame:
    """Interpolated average precision of each ranked list: the best precision at or after every relevant place; 1 without any."""
    ranked = Window.partitionBy(by).orderBy(*order)
    flag = relevant.cast("int")
    x = df.select(by, F.row_number().over(ranked).alias("pos"), flag.alias("rel"), F.sum(flag).over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    onward = Window.partitionBy(by).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    best = F.max(F.when(F.col("rel") == 1, F.col("hits") / F.col("pos"))).over(onward)
    y = x.withColumn("best", F.when(F.col("rel") == 1, best))
    total = F.sum("rel") + F.lit(missing)
    return y.groupBy(by).agg(r(F.when(total == 0, F.lit(1.0)).otherwise(F.coalesce(F.sum("best"), F.lit(0.0)) / total)).alias("ap"))


def g_score(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Signed log-likelihood ratio that two events occur together, from their counts; negative where they avoid each other."""

    def ll(k: Column, m: Column, p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-16)), F.lit(1e-300))
        return k * F.ln(p) + (m - k) * F.ln(1 - p)

    k1, n1, k2, n2 = ab.cast("double"), a.cast("double"), (b - ab).cast("double"), (n - a).cast("double")
    p1, p2, p = k1 / n1, F.coalesce(F.try_divide(k2, n2), F.lit(0.0)), (k1 + k2) / (n1 + n2)
    value = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when(p1 >= p2, value).otherwise(-value)


def event_correlation(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Pairs of items and how far they share baskets beyond chance. Items are categories: pairs follow the distinct items of a basket."""
    once = df.select(basket, item).distinct()
    n = once.select(basket).distinct().count()
    single = once.groupBy(item).agg(F.count("*").alias("c"))
    sets = once.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("s")).groupBy("s").agg(F.count("*").alias("w"))
    pair = sets.select("w", F.explode("s").alias("a"), "s").select("w", "a", F.explode(F.expr("filter(s, x -> x > a)")).alias("b"))
    both = pair.groupBy("a", "b").agg(F.sum("w").alias("n_ab"))
    out = both.join(single.select(F.col(item).alias("a"), F.col("c").alias("n_a")), "a").join(single.select(F.col(item).alias("b"), F.col("c").alias("n_b")), "b")
    return out.select("a", "b", "n_a", "n_b", "n_ab", r(g_score(F.col("n_a"), F.col("n_b"), F.col("n_ab"), F.lit(n)), 4).alias("score"))


def upper_quantile(df: DataFrame, value: str, q: float, ties: list[str]) -> DataFrame:
    """The element at place round((n - 1)(1 - q)) in ascending order; no interpolation."""
    ranked = numbered(df.select(value, *ties).filter(F.col(value).isNotNull()), [F.asc(value), *map(F.asc, ties)])
    n = df.filter(F.col(value).isNotNull()).count()
    place = int((n - 1) * (1 - q) + 0.5)
    return ranked.filter(F.col("pos") == place + 1).select(F.lit(q).alias("q"), F.col(value).alias("value"))


def length_profile(df: DataFrame, by: str, length: Column) -> DataFrame:
    """Lengths at the places floor(q(n - 1) + 0.5), their mean and most, and the share within 1024. Lengths are few distinct values, so they are counted first."""
    counts = df.select(by, length.alias("len")).groupBy(by, "len").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    up = w.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    x = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(w))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col("len")))

    return x.groupBy(by).agg(
        F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("len").alias("longest"),
        r(F.sum(F.col("len") * F.col("c")) / F.sum("c"), 4).alias("mean_len"), r(F.sum(F.when(F.col("len") <= 1025, F.col("c")).otherwise(0)) / F.sum("c")).alias("coverage"),
    )


def suggest_window(profile: DataFrame, granularity: int = 64, most: int = 0) -> DataFrame:
    """A window for each profile: the p90 length less one, rounded up to the granularity, capped, and at least the granularity."""
    up = (F.ceil((F.col("p90") - 1) / granularity) * granularity).cast("long")
    return profile.select(profile.columns[0], F.greatest(F.least(up, F.lit(most)) if most else up, F.lit(granularity).cast("long")).alias("window_len"))


def histogram(df: DataFrame, value: Column, low: float, width: float, bins: int) -> DataFrame:
    """Counts in equal bins, ends open into the first and last, and the equalised level of each bin by its running share."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / width))).cast("int")
    counts = df.filter(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over at most `bins` rows
    whole = Window.partitionBy()
    return counts.select("bin", "n", r(F.sum("n").over(run) / F.sum("n").over(whole) * (bins - 1), 4).alias("level"))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Counts of each pair of true and guessed label."""
    return df.groupBy(truth.alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))


def binary_rates(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Shares of positives and of negatives told apart, a score of 0 or more meaning positive."""
    hit = F.when(score >= 0, 1.0).otherwise(0.0)
    return df.agg(r(F.avg(F.when(truth, hit))).alias("positive_rate"), r(F.avg(F.when(~truth, 1 - hit))).alias("negative_rate"))


def regression_report(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """Mean squared error, correlation, mean absolute error and the deviation of absolute errors."""
    e = F.col(guess) - F.col(truth)
    return df.groupBy(*by).agg(r(F.avg(e * e), 4).alias("mse"), r(F.corr(guess, truth)).alias("corr"), r(F.avg(F.abs(e)), 4).alias("mae"), r(F.stddev_samp(F.abs(e)), 4).alias("sd_abs"))


def ranking_inversions(df: DataFrame, by: str, score: str, relevant: Column) -> DataFrame:
    """For each query: pairs of a relevant and a non-relevant item, those in the wrong order (ties count) and the pair accuracy."""
    up = Window.partitionBy(by).orderBy(score).rangeBetween(Window.unboundedPreceding, 0)
    flag = relevant.cast("int")
    x = df.select(by, flag.alias("rel"), F.sum(flag).over(up).alias("below"))
    y = x.groupBy(by).agg(F.sum("rel").alias("p"), F.sum(1 - F.col("rel")).alias("q"), F.sum(F.when(F.col("rel") == 0, F.col("below")).otherwise(0)).alias("inversions"))
    pairs = F.col("p") * F.col("q")
    return y.select(by, pairs.alias("pairs"), "inversions", r(F.when(pairs > 0, (pairs - F.col("inversions")) / pairs).otherwise(1.0)).alias("pair_accuracy"))


def trend(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Slope of values over their places 0, 1, ..., its standard error and how often it lies above 0 in units of that error."""
    w = Window.partitionBy(by).orderBy(*order)
    x = df.select(by, F.col(value).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"))
    g = x.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    n = F.col("n").cast("double")
    err = F.when(n > 2, F.sqrt(rss / (n - 2) * 12 / (n * n * n - n)))
    return g.select(by, "n", r(F.col("slope"), 8).alias("slope"), r(err, 8).alias("stderr"), r(F.try_divide("slope", err), 4).alias("z"))


def without_largest(df: DataFrame, by: str, value: str, ties: list[str], discard: float = 0.1) -> DataFrame:
    """The rows of each group whose value is at most that at place round((n - 1)(1 - discard)) in ascending order; for trends that single spikes must not turn."""
    group = Window.partitionBy(by)
    placed = df.filter(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(group.orderBy(value, *ties))).withColumn("_n", F.count("*").over(group))
    edge = F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * (1 - F.lit(discard)) + 0.5) + 1, F.col(value))).over(group)
    return placed.withColumn("_edge", edge).filter(F.col(value) <= F.col("_edge")).drop("_at", "_n", "_edge")


def share_difference(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood gain of two shares k / n over one common share, negative where the first is the smaller; 0 without any trials."""
    shares = [F.coalesce(F.try_divide(k.cast("double"), n), F.lit(0.0)) for k, n in ((k1, n1), (k2, n2), (k1 + k2, n1 + n2))]

    def ll(p: Column, k: Column, n: Column) -> Column:
        return F.when((p > 0) & (p < 1), k * F.ln(p) + (n - k) * F.ln(1 - p)).otherwise(0.0)

    p1, p2, both = shares
    gain = ll(p1, k1, n1) + ll(p2, k2, n2) - ll(both, k1, n1) - ll(both, k2, n2)
    return F.when(p1 >= p2, gain).otherwise(-gain)


def against_rest(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """For each group its hits, its rows and how far its share of hits differs from that of all other rows."""
    own = df.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    total = own.agg(F.sum("hits").alias("_h"), F.sum("n").alias("_n"))  # one row
    rest = share_difference(F.col("hits"), F.col("n"), F.col("_h") - F.col("hits"), F.col("_n") - F.col("n"))
    return own.crossJoin(F.broadcast(total)).select(by, "hits", "n", (r(rest, 5) + 0.0).alias("difference"))


def probability_increasing(z: float) -> float:
    """Normal distribution function of a slope over its error."""
    import math

    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def zscore(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Each column less its mean over its sample deviation, fitted in one aggregation."""
    fit = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(fit)).select(*keep, *[r((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 5).alias(f"z_{c}") for c in columns])  # one row


def reservoir(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows by the smallest hash of a key: a repeatable uniform sample; a top-k, so nothing is sorted whole."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of every pair of columns, all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (r(F.col(f"`{a}|{b}`"), 3) + F.lit(0.0)).alias("cov")) for a, b in pairs]))
    return one.select(rows.alias("p")).select("p.*")


def _lines(s, d):
    return table(s, d, "lineitem")


QUERIES = {
    "running_stats": lambda s, d: running_stats(_lines(s, d), ["l_returnflag", "l_linestatus"], "l_extendedprice"),
    "pair_statistics": lambda s, d: covariance(_lines(s, d).withColumn("d", F.col("l_discount") - 0.05), ["l_linestatus"], "l_tax", "d"),
    "decayed_stats": lambda s, d: decayed_stats(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 10),
    "cross_covariance": lambda s, d: cross_covariance(_lines(s, d), ["l_returnflag"], ["l_quantity", "l_tax"], ["l_discount", "l_extendedprice"]),
    "decayed_covariance": lambda s, d: decayed_covariance(table(s, d, "events").withColumn("hit", (F.col("event_type") == "click").cast("int")), "user_id", ["ts", "event_id"], "value", "hit", 10),
    "roc_curve": lambda s, d: roc(table(s, d, "events").withColumn("t", F.col("event_type") == "error"), "value", "t", ["event_id"]),
    "equal_error_rate": lambda s, d: equal_error_rate(table(s, d, "events").withColumn("t", F.col("event_type") == "error"), "value", "t", ["event_id"]),
    "average_precision": lambda s, d: average_precision(table(s, d, "events"), "user_id", [F.desc("value"), F.asc("event_id")], F.col("event_type") == "error"),
    "event_correlation": lambda s, d: event_correlation(table(s, d, "events"), "user_id", "event_type"),
    "upper_quantile": lambda s, d: upper_quantile(_lines(s, d), "l_extendedprice", 0.1, ["l_orderkey", "l_linenumber", "l_partkey"]),
    "length_profile": lambda s, d: length_profile(table(s, d, "documents"), "lang", F.length("text")),
    "suggest_window": lambda s, d: suggest_window(length_profile(table(s, d, "documents"), "lang", F.length("text"))),
    "histogram": lambda s, d: histogram(_lines(s, d), F.col("l_extendedprice"), 0.0, 5000.0, 20),
    "confusion_matrix": lambda s, d: confusion(table(s, d, "labels"), F.col("quality"), 1 - F.col("toxic")),
    "binary_rates": lambda s, d: binary_rates(table(s, d, "labels").join(table(s, d, "documents"), "doc_id"), F.col("quality") == 1, F.length("text") - 1000),
    "regression_report": lambda s, d: regression_report(_lines(s, d).withColumn("guess", F.col("l_quantity") * 1500), ["l_returnflag"], "l_extendedprice", "guess"),
    "ranking_inversions": lambda s, d: ranking_inversions(table(s, d, "events"), "user_id", "value", F.col("event_type") == "error"),
    "trend": lambda s, d: trend(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"),
    "robust_trend": lambda s, d: trend(without_largest(table(s, d, "events"), "user_id", "value", ["event_id"]), "user_id", ["ts", "event_id"], "value"),
    "share_difference": lambda s, d: against_rest(_lines(s, d), "l_suppkey", F.col("l_returnflag") == "R"),
    "zscore": lambda s, d: zscore(table(s, d, "supplier"), ["s_acctbal"], ["s_suppkey"]),
    "reservoir_sample": lambda s, d: reservoir(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100),
    "covariance_matrix": lambda s, d: covariance_matrix(_lines(s, d), ["l_quantity", "l_discount", "l_tax"]),
}

_GSCORE = """2 * (k1 * ln(greatest(least(k1/n1, 1 - 1e-16), 1e-300)) + (n1 - k1) * ln(1 - greatest(least(k1/n1, 1 - 1e-16), 1e-300))
  + k2 * ln(greatest(least(coalesce(k2/nullif(n2, 0), 0), 1 - 1e-16), 1e-300)) + (n2 - k2) * ln(1 - greatest(least(coalesce(k2/nullif(n2, 0), 0), 1 - 1e-16), 1e-300))
  - k1 * ln(p) - (n1 - k1) * ln(1 - p) - k2 * ln(p) - (n2 - k2) * ln(1 - p))"""

_PROFILE = """SELECT lang, n, min(len) FILTER (upto > floor(0.5 * (n - 1) + 0.5)) AS p50, min(len) FILTER (upto > floor(0.9 * (n - 1) + 0.5)) AS p90,
  min(len) FILTER (upto > floor(0.99 * (n - 1) + 0.5)) AS p99, max(len) AS longest, round(avg(len), 4) AS mean_len, round(avg(CASE WHEN len <= 1025 THEN 1.0 ELSE 0.0 END), 6) AS coverage
  FROM (SELECT lang, length(text)::INT AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS upto, count(*) OVER (PARTITION BY lang) AS n FROM documents) GROUP BY lang, n"""

ORACLES = {
    "running_stats": """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS lowest,
  max(l_extendedprice) AS highest, round(var_samp(l_extendedprice), 4) AS variance, round(stddev_samp(l_extendedprice), 6) AS stddev, round(skewness(l_extendedprice), 6) AS skew,
  round(kurtosis(l_extendedprice), 6) AS ex_kurtosis FROM lineitem GROUP BY 1, 2""",
    "pair_statistics": """SELECT l_linestatus, round(covar_samp(l_tax, d), 4) AS cov, round(corr(l_tax, d), 6) AS corr, round(corr(l_tax, d) * corr(l_tax, d), 6) AS r_squared,
  round(avg((l_tax - d) * (l_tax - d)), 3) AS mse, round(avg(CASE WHEN (l_tax >= 0) = (d >= 0) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement
  FROM (SELECT *, l_discount - 0.05::DOUBLE AS d FROM lineitem) GROUP BY 1""",
    "decayed_stats": """WITH x AS (SELECT user_id, value AS v, pow(0.5, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) / 10.0) AS w FROM events)
SELECT user_id, count(*) AS n, round(sum(w * v) / sum(w), 5) AS mean, round(greatest(0.0, sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2)), 4) AS variance FROM x GROUP BY 1""",
    "cross_covariance": " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS x, '{y}' AS y, round(covar_samp({x}, {y}), 5) + 0.0 AS cov FROM lineitem GROUP BY 1" for x in ("l_quantity", "l_tax") for y in ("l_discount", "l_extendedprice")),
    "decayed_covariance": """WITH e AS (SELECT user_id, value AS x, (event_type = 'click')::INT AS y, pow(0.5, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) / 10.0) AS w FROM events),
s AS (SELECT user_id, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy FROM e GROUP BY 1)
SELECT user_id, round(CASE WHEN n > 1 THEN (xy - x * y / n) / (n - 1) END, 4) AS cov, round(CASE WHEN n > 1 THEN (xy - x * y / n) / nullif(sqrt((xx - x * x / n) * (yy - y * y / n)), 0) END, 5) AS corr FROM s""",
    "roc_curve": """WITH e AS (SELECT event_id, value, (event_type = 'error')::INT AS t FROM events)
SELECT event_id, value AS threshold, round(sum(t) OVER w / (SELECT sum(t) FROM e), 6) AS tpr, round(sum(1 - t) OVER w / (SELECT sum(1 - t) FROM e), 6) AS fpr FROM e
WINDOW w AS (ORDER BY value DESC, t, event_id ROWS UNBOUNDED PRECEDING)""",
    "equal_error_rate": """WITH e AS (SELECT event_id, value, (event_type = 'error')::INT AS t FROM events),
x AS (SELECT value, row_number() OVER w AS rn, 1 - sum(t) OVER w / (SELECT sum(t) FROM e) AS fnr, sum(1 - t) OVER w / (SELECT sum(1 - t) FROM e) AS fpr FROM e
  WINDOW w AS (ORDER BY value DESC, t, event_id ROWS UNBOUNDED PRECEDING))
SELECT round(greatest(fnr, fpr), 6) AS rate, value AS threshold FROM x ORDER BY round(abs(fnr - fpr), 12), rn LIMIT 1""",
    "average_precision": """WITH x AS (SELECT user_id, (event_type = 'error')::INT AS rel, row_number() OVER w AS pos, sum((event_type = 'error')::INT) OVER w AS hits FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, max(CASE WHEN rel = 1 THEN hits / pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM x)
SELECT user_id, round(CASE WHEN sum(rel) = 0 THEN 1.0 ELSE sum(CASE WHEN rel = 1 THEN best END) / sum(rel) END, 6) AS ap FROM y GROUP BY 1""",
    "event_correlation": f"""WITH o AS (SELECT DISTINCT user_id, event_type AS i FROM events), s AS (SELECT i, count(*) AS c FROM o GROUP BY 1),
b AS (SELECT x.i AS a, y.i AS b, count(*) AS n_ab FROM o x JOIN o y ON x.user_id = y.user_id AND x.i < y.i GROUP BY 1, 2),
j AS (SELECT a, b, s1.c AS n_a, s2.c AS n_b, n_ab, n_ab::DOUBLE AS k1, s1.c::DOUBLE AS n1, (s2.c - n_ab)::DOUBLE AS k2, ((SELECT count(DISTINCT user_id) FROM o) - s1.c)::DOUBLE AS n2
  FROM b JOIN s s1 ON a = s1.i JOIN s s2 ON b = s2.i),
p AS (SELECT *, greatest(least((k1 + k2) / (n1 + n2), 1 - 1e-16), 1e-300) AS p FROM j)
SELECT a, b, n_a, n_b, n_ab, round(CASE WHEN k1 / n1 >= coalesce(k2 / nullif(n2, 0), 0) THEN 1 ELSE -1 END * {_GSCORE}, 4) AS score FROM p""",
    "upper_quantile": """SELECT 0.1::DOUBLE AS q, l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem)
WHERE rn = floor((n - 1) * (1 - 0.1::DOUBLE) + 0.5) + 1""",
    "length_profile": _PROFILE,
    "suggest_window": f"SELECT lang, greatest(ceil((p90 - 1) / 64.0) * 64, 64)::BIGINT AS window_len FROM ({_PROFILE})",
    "histogram": """SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER () * 19, 4) AS level FROM (SELECT greatest(0, least(19, floor(l_extendedprice / 5000)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1)""",
    "confusion_matrix": "SELECT quality AS truth, 1 - toxic AS guess, count(*) AS n FROM labels GROUP BY 1, 2",
    "binary_rates": """SELECT round(avg(CASE WHEN length(text) >= 1000 THEN 1.0 ELSE 0.0 END) FILTER (quality = 1), 6) AS positive_rate, round(avg(CASE WHEN length(text) < 1000 THEN 1.0 ELSE 0.0 END) FILTER (quality <> 1), 6) AS negative_rate
FROM labels JOIN documents USING (doc_id)""",
    "regression_report": """SELECT l_returnflag, round(avg(e * e), 4) AS mse, round(corr(g, l_extendedprice), 6) AS corr, round(avg(abs(e)), 4) AS mae, round(stddev_samp(abs(e)), 4) AS sd_abs
FROM (SELECT *, l_quantity * 1500 AS g, l_quantity * 1500 - l_extendedprice AS e FROM lineitem) GROUP BY 1""",
    "ranking_inversions": """WITH x AS (SELECT user_id, (event_type = 'error')::INT AS rel, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS below FROM events),
y AS (SELECT user_id, sum(rel) AS p, sum(1 - rel) AS q, sum(CASE WHEN rel = 0 THEN below ELSE 0 END) AS inv FROM x GROUP BY 1)
SELECT user_id, (p * q)::BIGINT AS pairs, inv::BIGINT AS inversions, round(CASE WHEN p * q > 0 THEN (p * q - inv) / (p * q) ELSE 1.0 END, 6) AS pair_accuracy FROM y""",
    "trend": """WITH x AS (SELECT user_id, value AS y, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS x FROM events),
g AS (SELECT user_id, count(*) AS n, regr_slope(y, x) AS slope, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM x GROUP BY 1),
e AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0.0) / (n - 2) * 12 / (n::DOUBLE * n * n - n)) END AS err FROM g)
SELECT user_id, n, round(slope, 8) AS slope, round(err, 8) AS stderr, round(slope / nullif(err, 0), 4) AS z FROM e""",
    "robust_trend": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS m FROM events),
v AS (SELECT user_id, value AS edge FROM k WHERE pos = floor((m - 1) * (1 - 0.1::DOUBLE) + 0.5) + 1),
x AS (SELECT user_id, value AS y, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS x FROM events JOIN v USING (user_id) WHERE value <= edge),
g AS (SELECT user_id, count(*) AS n, regr_slope(y, x) AS slope, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM x GROUP BY 1),
e AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0.0) / (n - 2) * 12 / (n::DOUBLE * n * n - n)) END AS err FROM g)
SELECT user_id, n, round(slope, 8) AS slope, round(err, 8) AS stderr, round(slope / nullif(err, 0), 4) AS z FROM e""",
    "share_difference": """WITH o AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(hits) OVER () - hits AS k2, sum(n) OVER () - n AS n2, hits / n AS p1, coalesce((sum(hits) OVER () - hits) / nullif(sum(n) OVER () - n, 0), 0) AS p2, sum(hits) OVER () / sum(n) OVER () AS p FROM o),
g AS (SELECT *, CASE WHEN p1 IN (0, 1) THEN 0 ELSE hits * ln(p1) + (n - hits) * ln(1 - p1) END + CASE WHEN p2 IN (0, 1) THEN 0 ELSE k2 * ln(p2) + (n2 - k2) * ln(1 - p2) END
  - CASE WHEN p IN (0, 1) THEN 0 ELSE (hits + k2) * ln(p) + (n + n2 - hits - k2) * ln(1 - p) END AS gain FROM t)
SELECT l_suppkey, hits, n, round(CASE WHEN p1 >= p2 THEN gain ELSE -gain END, 5) + 0.0 AS difference FROM g""",
    "zscore": "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 5) AS z_s_acctbal FROM supplier",
    "reservoir_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 100",
    "covariance_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 3) + 0.0 AS cov FROM lineitem"
        for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))
    ),
}
