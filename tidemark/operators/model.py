"""A cross-validated logistic baseline with MLlib: features by training folds, weightings, grid, one-standard-error rule,
baselines and diagnostics.

Rows: trade_key, condition_id, category, cv_fold, price, label (0/1), market_weight, sample_weight, the numeric features, and
for the diagnostics heuristic_score, entry_price and gross_pnl. Only figures of a bounded size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

WEIGHTINGS = ("none", "sample", "market", "sample_x_market")
FEATURE_SETS = ("price_only", "price_category", "full", "full_interactions")
#: Trades below a price, by the name of the filter.
FILTERS = {"all": None, "price_lt_0.95": 0.95}
C_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
L1_SHARES = (0.0, 0.5)
EPS, CLIP, EDGE = 1e-6, 0.001, 0.02
# The numeric features of a training set, those that are logged first, and the flags that go with them.
LOGGED = (
    "notional_usd", "days_since_market_start", "hours_to_scheduled_end", "wallet_observed_trade_count", "wallet_distinct_market_count", "wallet_distinct_outcome_count", "wallet_active_days",
    "wallet_mean_notional_usd", "wallet_median_notional_usd", "wallet_p90_notional_usd", "wallet_max_notional_usd", "wallet_stddev_notional_usd", "wallet_cheap_trade_count",
    "wallet_last_7d_trade_count", "wallet_last_7d_notional_usd", "wallet_seconds_since_last_trade", "wallet_buy_count", "wallet_sell_count", "size_vs_median", "same_asset_buys_1h",
    "same_asset_notional_1h_usd", "burst_size",
)
RAW = ("fraction_of_market_life_elapsed", "wallet_mean_price", "wallet_largest_market_volume_share", "wallet_buy_notional_share", "history_truncated")
FLAGS = ("missing_days_since_market_start", "missing_hours_to_scheduled_end", "missing_fraction_of_market_life_elapsed", "missing_size_vs_median", "missing_wallet_mean_notional_usd")


@dataclass(frozen=True)
class Inputs:
    """Which columns are logged, taken as they are, and flags of what is missing."""

    logged: tuple[str, ...] = LOGGED
    raw: tuple[str, ...] = RAW
    flags: tuple[str, ...] = FLAGS

    def present(self, columns: Iterable[str]) -> Inputs:
        have = set(columns)
        return Inputs(*(tuple(n for n in names if n in have) for names in (self.logged, self.raw, self.flags)))


@dataclass(frozen=True)
class Candidate:
    """c: infinite for no penalty; l1: the share of the absolute penalty."""

    features: str
    weighting: str
    c: float = math.inf
    l1: float = 0.0
    filter: str = "all"

    @property
    def penalty(self) -> str:
        return "none" if math.isinf(self.c) else "l2" if not self.l1 else f"elasticnet({self.l1:g})"

    @property
    def key(self) -> str:
        return "|".join((self.filter, self.features, self.weighting, self.penalty, f"C={self.c:g}"))

    @property
    def simplicity(self) -> tuple:
        """Fewer features are simpler, then a smaller share of the absolute penalty, then a stronger penalty."""
        return (FEATURE_SETS.index(self.features), self.l1, -1.0 if math.isinf(self.c) else self.c)

    @property
    def cost(self) -> float:
        """How long a fit takes, about; the longest start first."""
        if math.isinf(self.c):
            return 0.0
        return (1.0 + FEATURE_SETS.index(self.features)) * (10 * (1 + self.c) if self.l1 else 1)


def grid(c_values: Iterable[float] = C_GRID, l1: Iterable[float] = L1_SHARES, weightings: Iterable[str] = WEIGHTINGS, features: Iterable[str] = FEATURE_SETS, filter_: str = "all") -> list[Candidate]:
    """Price alone without penalty; categories with a square penalty; more features with each share of absolute penalty."""
    out = []
    for w in weightings:
        for f in features:
            if f == "price_only":
                out.append(Candidate(f, w, filter=filter_))
            else:
                out += [Candidate(f, w, c, x, filter_) for x in l1 if not (x and f == "price_category") for c in c_values]
    return out


@dataclass
class Builder:
    """Numbers of the training rows that make the features of any rows."""

    inputs: Inputs
    categories: list[str]
    fill: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def _numeric(self) -> dict[str, Column]:
        """Logged and raw features, null where there is no finite value."""
        value = lambda n: S.finite(F.col(n).cast("double"))
        return {f"log_{n}": S.signed_log1p(value(n)) for n in self.inputs.logged} | {n: value(n) for n in self.inputs.raw}

    def _raw(self, kind: str) -> dict[str, Column]:
        price = S.logit(F.col("price"), CLIP)
        cols = {"logit_price": price}
        if kind != "price_only":
            cols |= {f"category={c}": F.coalesce(F.col("category") == c, F.lit(False)).cast("double") for c in self.categories}
        if kind in ("full", "full_interactions"):
            filled = {n: F.coalesce(c, F.lit(self.fill.get(n, 0.0))) for n, c in self._numeric().items()}
            cols |= filled | {n: F.coalesce(F.col(n).cast("double"), F.lit(1.0)) for n in self.inputs.flags}
            if kind == "full_interactions":
                cols |= {f"{n}*logit_price": c * price for n, c in filled.items()}
        return cols

    def fit(self, rows: DataFrame, kind: str) -> Builder:
        numeric = self._numeric() if kind in ("full", "full_interactions") else {}
        if numeric:
            medians = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(numeric.values())]).first()
            self.fill = {n: medians[f"m{i}"] or 0.0 for i, n in enumerate(numeric)}
        cols = self._raw(kind)
        stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols.values())], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols.values())]).first()
        self.mean = {n: stats[f"m{i}"] or 0.0 for i, n in enumerate(cols)}
        self.scale = {n: stats[f"s{i}"] or 1.0 for i, n in enumerate(cols)}
        return self

    def transform(self, rows: DataFrame, kind: str) -> DataFrame:
        cols = self._raw(kind)
        made = rows.withColumns({f"_x{i}": (c - self.mean[n]) / self.scale[n] for i, (n, c) in enumerate(cols.items())})
        return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="features").transform(made).drop(*[f"_x{i}" for i in range(len(cols))])


def weight(weighting: str) -> Column:
    """The weight of a training row; fit_logistic scales them to a mean of 1."""
    return {"none": F.lit(1.0), "market": F.col("market_weight"), "sample": F.col("sample_weight"), "sample_x_market": F.col("market_weight") * F.col("sample_weight")}[weighting].cast("double")


#: Fixed weights of the evaluation: each market counts about once, or each trade once.
MARKET, TRADE = "sample_weight * market_weight", "sample_weight"


def fit_logistic(rows: DataFrame, candidate: Candidate):
    """C is the weight of the data against the penalty: regParam = 1 / (C x the sum of weights). The intercept is free."""
    total = rows.agg(F.sum("w").alias("s"), F.count("*").alias("n")).first()
    rows = rows.withColumn("w", F.col("w") * (total["n"] / total["s"]))
    penalty = 0.0 if math.isinf(candidate.c) else 1.0 / (candidate.c * total["n"])
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=penalty, elasticNetParam=candidate.l1, standardization=False, maxIter=200, tol=1e-7).fit(rows)


def _predicted(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(rows: DataFrame, candidate: Candidate, inputs: Inputs, categories: list[str], k: int) -> DataFrame:
    """rows with prediction p for each held-out fold, by a model of the other folds."""
    parts = []
    for f in range(k):
        train, test = rows.where(F.col("cv_fold") != f), rows.where(F.col("cv_fold") == f)
        b = Builder(inputs, categories).fit(train, candidate.features)
        model = fit_logistic(b.transform(train, candidate.features).withColumn("w", weight(candidate.weighting)), candidate)
        parts.append(_predicted(model, b.transform(test, candidate.features)))
    return _union(parts)


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def metrics(rows: DataFrame, by: list[str], w: str = MARKET, p: str = "p") -> DataFrame:
    """Weighted log loss and Brier score by group."""
    mean = lambda c: F.sum(c * F.expr(w)) / F.sum(F.expr(w))
    q = F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean(log_loss(F.col(p), F.col("label"))).alias("log_loss"), mean(F.pow(q - F.col("label"), F.lit(2))).alias("brier"))


#: Ranges of predictions, within which they are ordered in parallel.
RANGES = 4096


def auc(rows: DataFrame, p: str = "p", label: str = "label", w: str = MARKET, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted area under the ROC curve by group: pairs by rank, ties half; null where a label is missing.

    Equal predictions are one row before they are ordered, within ranges of predictions; the ranges' sums are added before.
    """
    good, bad = F.sum(F.when(F.col(label) == 1, F.expr(w)).otherwise(0.0)), F.sum(F.when(F.col(label) == 0, F.expr(w)).otherwise(0.0))
    t = rows.groupBy(*by, F.col(p).alias("_p")).agg(good.alias("a"), bad.alias("b")).withColumn("_r", F.least(F.lit(RANGES - 1), F.floor(F.col("_p") * RANGES)))
    ahead = lambda part, order: F.coalesce(F.sum("b").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranges = t.groupBy(*by, "_r").agg(F.sum("b").alias("b")).withColumn("_before", ahead(by, "_r")).drop("b")
    below = t.withColumn("_within", ahead([*by, "_r"], "_p")).join(ranges, [*by, "_r"]).withColumn("below", F.col("_within") + F.col("_before"))
    area = F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)) / F.nullif(F.sum("a") * F.sum("b"), F.lit(0.0))
    return below.groupBy(*by).agg(area.alias("auc")) if by else below.agg(area.alias("auc"))


def quantile_edges(rows: DataFrame, p: str, fractions: list[float]) -> list[float]:
    """Exact quantiles of shares in [0, 1] by linear interpolation, from counts by range and the few ranges that hold them."""
    placed = rows.where(F.col(p).isNotNull()).withColumn("_r", F.least(F.lit(RANGES * 16 - 1), F.floor(F.col(p) * RANGES * 16)))
    counts = sorted((r["_r"], r["n"]) for r in placed.groupBy("_r").agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    if not n:
        return []
    wanted = {int(i) for q in fractions for i in (math.floor((n - 1) * q), min(math.floor((n - 1) * q) + 1, n - 1))}
    starts, total = {}, 0
    for r, c in counts:
        if any(total <= i < total + c for i in wanted):
            starts[r] = total
        total += c
    spark = rows.sparkSession
    begin = F.broadcast(spark.createDataFrame(list(starts.items()), "_r long, _begin long"))
    equal = placed.join(begin, "_r").groupBy("_r", "_begin", F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    upto = F.col("_begin") + F.sum("_n").over(Window.partitionBy("_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    spans = equal.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    asked = F.broadcast(spark.createDataFrame([(i,) for i in sorted(wanted)], "i long"))
    found = {r["i"]: r["_p"] for r in spans.join(asked, (F.col("i") >= F.col("_from")) & (F.col("i") < F.col("_upto"))).select("i", "_p").collect()}
    out = []
    for q in fractions:
        at = (n - 1) * q
        low = math.floor(at)
        a, b = found[low], found[min(low + 1, n - 1)]
        out.append(a + (b - a) * (at - low))
    return out


def calibration(rows: DataFrame, bins: int = 10, w: str = TRADE, p: str = "p") -> DataFrame:
    """Weighted mean prediction, outcome and price by bins between quantiles of the predictions; empty bins are left out."""
    edges = quantile_edges(rows, p, [i / bins for i in range(1, bins)])
    mean = lambda c: F.sum(c * F.expr(w)) / F.sum(F.expr(w))
    bin_ = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col(p)))
    extra = [mean(F.col("price")).alias("mean_price")] if "price" in rows.columns else []
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), mean(F.col(p)).alias("mean_p"), mean(F.col("label")).alias("mean_label"), *extra)


def mean_and_se(per_fold: DataFrame, by: list[str], value: str = "log_loss") -> DataFrame:
    return per_fold.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))


def fold_deltas(per_fold: DataFrame, by: list[str], reference: Column, fold: str = "cv_fold", value: str = "log_loss") -> DataFrame:
    """Mean and standard error over folds of each candidate's difference from the reference of the same ``by``."""
    base = per_fold.where(reference).select(*by, fold, F.col(value).alias("_base"))
    diffs = per_fold.join(base, [*by, fold]).withColumn("_d", F.col(value) - F.col("_base"))
    return diffs.groupBy("candidate", *by).agg(F.avg("_d").alias("delta"), F.coalesce(F.stddev_samp("_d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("delta_se"))


def one_standard_error(results: list[tuple[Candidate, float, float]]) -> Candidate:
    """The simplest candidate within one standard error of the best; of equally simple ones the best."""
    _, best, se = min(results, key=lambda r: r[1])
    return min((r for r in results if r[1] <= best + se), key=lambda r: (r[0].simplicity, r[1]))[0]


def cluster_bootstrap(rows: DataFrame, value: Column, cluster: str, w: Column, resamples: int = 1000, seed: int = 0) -> tuple[float, float, float]:
    """Weighted mean of value with a 95 % interval, by resampling clusters.

    Each cluster's sums draw a Poisson count per replicate from its hash, so nothing but one row of sums a replicate is
    gathered, whatever the number of clusters.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value * w).alias("s"), F.sum(w).alias("w"))

    def resampled(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((resamples, 2))
        for b in batches:
            for key, s, x in zip(b[cluster].astype(str), b["s"], b["w"], strict=True):
                n = np.random.default_rng([seed, *key.encode()]).poisson(1.0, resamples)
                total += np.outer(n, [s, x])
        yield pd.DataFrame({"replicate": range(resamples), "s": total[:, 0], "w": total[:, 1]})

    reps = sums.mapInPandas(resampled, "replicate int, s double, w double").groupBy("replicate").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    whole = sums.agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).first()
    low, high = reps.first()["ci"] or (math.nan, math.nan)
    return whole["m"], low, high


def categories_of(rows: DataFrame, most: int = 1000) -> list:
    """The categories in their order; more than ``most`` are an error."""
    found = [r["category"] for r in rows.select("category").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} categories")
    return sorted(found)


def scores_of(rows: DataFrame, p: str = "p") -> dict:
    """Mean and standard error of the folds' log loss, and pooled scores by market and by trade weight."""
    folds = [r["log_loss"] for r in metrics(rows, ["cv_fold"], MARKET, p).orderBy("cv_fold").select("log_loss").collect()]
    pooled = {n: metrics(rows, [], w, p).join(auc(rows, p, w=w), F.lit(True)).first().asDict() for n, w in (("market", MARKET), ("trade", TRADE))}
    x = np.array(folds)
    return {"fold_log_loss": folds, "mean": float(x.mean()), "se": float(x.std(ddof=1) / math.sqrt(len(x))) if len(x) > 1 else 0.0, **pooled}


def with_baselines(rows: DataFrame, k: int) -> DataFrame:
    """Adds out-of-fold reference predictions: p_constant (the other folds' win rate by trade weight), p_price (the price
    itself, clipped) and p_heuristic (a logistic model of price and heuristic score, without weights or penalty)."""
    sums = rows.groupBy("cv_fold").agg(F.sum(F.col("label") * F.expr(TRADE)).alias("s"), F.sum(F.expr(TRADE)).alias("w")).collect()
    s, w = sum(r["s"] for r in sums), sum(r["w"] for r in sums)
    rate = F.create_map(*[F.lit(x) for r in sums for x in (r["cv_fold"], float((s - r["s"]) / (w - r["w"]) if w > r["w"] else 0.0))])
    rows = rows.withColumns({"p_constant": rate[F.col("cv_fold")], "p_price": F.greatest(F.least(F.col("price"), F.lit(1 - CLIP)), F.lit(CLIP)), "_h": F.coalesce(F.col("heuristic_score").cast("double"), F.lit(0.0))})
    found = out_of_fold(rows, Candidate("full", "none"), Inputs((), ("_h",), ()), [], k)
    return found.withColumnRenamed("p", "p_heuristic").drop("_h")


def delayed_price(rows: DataFrame, entry: str = "entry_price") -> DataFrame:
    """Scores of the trade's price and of the price that a follower would have paid, where there is one."""
    there = rows.where(F.col(entry).isNotNull()).withColumn("p_entry", F.greatest(F.least(F.col(entry), F.lit(1 - CLIP)), F.lit(CLIP)))
    named = lambda p: metrics(there, [], p=p).select(F.lit(p).alias("predictor"), "n", "log_loss", "brier")
    return named("p_price").unionByName(named("p_entry"))


def by_category(rows: DataFrame, p: str = "p", base: str = "p_price") -> DataFrame:
    """Trades, markets, and the log loss and AUC of a model and of a reference in each category."""
    out = rows.groupBy("category").agg(F.count("*").alias("trades"), F.count_distinct("condition_id").alias("markets"))
    for name, column in (("model", p), ("price", base)):
        out = out.join(metrics(rows, ["category"], p=column).select("category", F.col("log_loss").alias(f"{name}_log_loss")), "category").join(auc(rows, column, by=["category"]).withColumnRenamed("auc", f"{name}_auc"), "category")
    return out


def follow_diagnostic(rows: DataFrame, p: str = "p", edge: float = EDGE, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(group, trades, markets, mean_pnl_trade, mean_pnl_market, low, high): the gross P&L of trades with a delayed price, and
    of those where the prediction beats it by ``edge``; the interval resamples markets and needs two of them."""
    there = rows.where(F.col("entry_price").isNotNull() & F.col("gross_pnl").isNotNull())
    out = []
    for name, group in (("all_with_delayed_price", there), ("flagged", there.where(F.col(p) - F.col("entry_price") > edge))):
        mean = lambda w: F.sum(F.col("gross_pnl") * F.expr(w)) / F.nullif(F.sum(F.expr(w)), F.lit(0.0))
        r = group.agg(F.count("*").alias("trades"), F.count_distinct("condition_id").alias("markets"), mean(TRADE).alias("t"), mean(MARKET).alias("m")).first()
        low, high = cluster_bootstrap(group, F.col("gross_pnl"), "condition_id", F.expr(TRADE), resamples, seed)[1:] if r["markets"] >= 2 and resamples else (None, None)
        out.append((name, r["trades"], r["markets"], r["t"], r["m"], low, high))
    return rows.sparkSession.createDataFrame(out, "group string, trades long, markets long, mean_pnl_trade double, mean_pnl_market double, low double, high double")


def filtered(rows: DataFrame, name: str) -> DataFrame:
    limit = FILTERS[name]
    return rows if limit is None else rows.where(F.col("price") < limit)


def train_baseline(rows: DataFrame, inputs: Inputs | None = None, candidates: list[Candidate] | None = None, k: int = 5, jobs: int = 4, filter_: str = "all") -> dict:
    """Scores the candidates out of fold, chooses by the one-standard-error rule and fits the choice on all rows.

    Gives the results, the choice, its predictions (oof) and those of price alone, the refitted model and its coefficients.
    """
    rows = filtered(rows.where("split = 'train' and label is not null and cv_fold is not null"), filter_).cache()
    if rows.select("cv_fold").distinct().count() < 2:
        raise ValueError(f"filter {filter_} leaves fewer than two folds")
    inputs = (inputs or Inputs()).present(rows.columns)
    categories = categories_of(rows)
    candidates = candidates if candidates is not None else grid(filter_=filter_)

    def score(c: Candidate) -> tuple[Candidate, dict]:
        return c, scores_of(out_of_fold(rows, c, inputs, categories, k))

    with ThreadPoolExecutor(jobs) as pool:
        scored = dict(pool.map(score, sorted(candidates, key=lambda c: -c.cost)))
    results = [(c, scored[c]["mean"], scored[c]["se"]) for c in candidates]
    chosen = one_standard_error(results)
    alone = [r for r in results if r[0].features == "price_only"]
    price_only = min(alone, key=lambda r: r[1])[0] if alone else chosen
    deltas = {}
    for c in candidates:
        base = next((r[0] for r in alone if r[0].weighting == c.weighting), None)
        if base is not None:
            d = np.array(scored[c]["fold_log_loss"]) - np.array(scored[base]["fold_log_loss"])
            deltas[c] = (float(d.mean()), float(d.std(ddof=1) / math.sqrt(len(d))) if len(d) > 1 else 0.0)
    builder = Builder(inputs, categories).fit(rows, chosen.features)
    model = fit_logistic(builder.transform(rows, chosen.features).withColumn("w", weight(chosen.weighting)), chosen)
    names = list(builder._raw(chosen.features))
    coefficients = sorted(zip(names, model.coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))
    return {
        "rows": rows, "results": results, "scores": scored, "deltas": deltas, "chosen": chosen, "best": min(results, key=lambda r: r[1])[0], "price_only": price_only, "model": model, "builder": builder,
        "coefficients": coefficients, "intercept": model.intercept, "oof": out_of_fold(rows, chosen, inputs, categories, k), "oof_price": out_of_fold(rows, price_only, inputs, categories, k),
    }
