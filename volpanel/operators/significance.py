"""Pairwise tests of predictive accuracy with Newey-West long-run variances."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import blank, finite, normal_cdf

METRICS = {"squared_error": "mse", "absolute_error": "absolute_error", "qlike": "qlike"}
KEYS = ("training_window", "benchmark_model", "relative_model", "metric", "ticker")


def pair_losses(panel: DataFrame, tested: str, benchmarks: list[str], metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """(KEYS, metric_column, sector, target_date, benchmark_loss, relative_loss, difference), all finite: one grouping brings the models together."""
    models = [tested, *benchmarks]
    wide = panel.groupBy("training_window", "ticker", "target_date").agg(
        *(F.first(F.when(F.col("model") == m, F.col(c)), ignorenulls=True).alias(f"l_{i}_{c}") for i, m in enumerate(models) for c in metrics),
        *(F.max(F.when((F.col("model") == m) & ~blank("sector"), F.col("sector"))).alias(f"s_{i}") for i, m in enumerate(models)),
    )
    made = F.array(*(
        F.struct(
            F.lit(b).alias("benchmark_model"), F.lit(METRICS.get(c, c)).alias("metric"), F.lit(c).alias("metric_column"), F.coalesce("s_0", f"s_{i}").alias("sector"),
            F.col(f"l_{i}_{c}").alias("benchmark_loss"), F.col(f"l_0_{c}").alias("relative_loss"),
        )
        for i, b in enumerate(benchmarks, 1) for c in metrics
    ))
    rows = wide.select("training_window", "ticker", "target_date", F.lit(tested).alias("relative_model"), F.explode(made).alias("x")).select("*", "x.*").drop("x")
    rows = rows.withColumn("difference", F.col("benchmark_loss") - F.col("relative_loss"))
    return rows.where(finite("benchmark_loss") & finite("relative_loss") & finite("difference"))


def stock_tests(pairs: DataFrame, alpha: float = 0.05, lag: int | None = None) -> DataFrame:
    """One test per ticker, window, benchmark and metric; positive differences favour the tested model.

    The differences of a group, ordered by date, are one array: autocovariances at a few lags are folds over it. Variances
    divide by n.
    """
    first = F.min_by("sector", F.when(~blank("sector"), F.col("target_date")))
    g = pairs.groupBy(*KEYS, "metric_column").agg(
        F.array_sort(F.collect_list(F.struct("target_date", "difference"))).alias("d"), F.avg("benchmark_loss").alias("mean_benchmark_loss"),
        F.avg("relative_loss").alias("mean_relative_loss"), F.avg("difference").alias("mean_difference"), F.count("*").alias("n_obs"), first.alias("sector"),
    )
    auto = F.floor(4 * F.pow(F.col("n_obs") / 100.0, F.lit(2 / 9))) if lag is None else F.lit(lag)
    g = g.withColumn("nw_lag", F.least(F.greatest(auto.cast("int"), F.lit(0)), (F.col("n_obs") - 1).cast("int")))
    g = g.withColumn("c", F.transform("d.difference", lambda x: x - F.col("mean_difference")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def at_lag(k: Column) -> Column:
        return total(F.zip_with(F.slice("c", k + 1, F.col("n_obs").cast("int") - k), F.slice("c", 1, F.col("n_obs").cast("int") - k), lambda x, y: x * y)) / F.col("n_obs")

    lags = F.when(F.col("nw_lag") > 0, F.sequence(F.lit(1), F.greatest("nw_lag", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    terms = total(F.transform(lags, lambda k: 2 * (1 - k / (F.col("nw_lag") + 1)) * at_lag(k)))
    g = g.withColumn("long_run_variance", total(F.transform("c", lambda x: x * x)) / F.col("n_obs") + terms)
    valid = finite("long_run_variance") & (F.col("long_run_variance") > 0)
    g = g.withColumn("dmw_stat", F.when(valid, F.sqrt("n_obs") * F.col("mean_difference") / F.sqrt("long_run_variance")))
    z = NormalDist().inv_cdf(1 - alpha)
    better, worse = (F.col("mean_difference") > 0) & (F.col("dmw_stat") > z), (F.col("mean_difference") < 0) & (F.col("dmw_stat") < -z)
    result = F.when(~valid, "invalid_variance").when(better, "significant_improvement").when(worse, "significant_underperformance").otherwise("not_significant")
    usable = finite("mean_benchmark_loss") & (F.col("mean_benchmark_loss") != 0)
    return g.select(
        *KEYS, "metric_column", "sector", "n_obs", "nw_lag", "mean_benchmark_loss", "mean_relative_loss", "mean_difference",
        F.when(usable, 100 * F.try_divide("mean_difference", "mean_benchmark_loss")).alias("pct_loss_reduction"), "long_run_variance", "dmw_stat",
        normal_cdf(-F.col("dmw_stat")).alias("p_improvement"), normal_cdf(F.col("dmw_stat")).alias("p_underperformance"), result.alias("test_result"),
        F.when(valid, "valid").otherwise("invalid").alias("test_status"),
    )


CLASSES = ("significant_improvement", "significant_underperformance", "not_significant")


def summary(tests: DataFrame) -> DataFrame:
    """Counts and percentages of each class over valid tests."""
    out = tests.where("test_status = 'valid'").groupBy("training_window", "benchmark_model", "relative_model", "metric").agg(
        F.count_distinct("ticker").alias("n_tickers"), *(F.count_if(F.col("test_result") == c).alias(f"n_{c}") for c in CLASSES),
        F.avg(F.when(finite("pct_loss_reduction"), F.col("pct_loss_reduction"))).alias("mean_pct_loss_reduction"),
    )
    return out.withColumns({f"pct_{c}": 100 * F.col(f"n_{c}") / F.col("n_tickers") for c in CLASSES})


def shares_to_plot(summaries: DataFrame, benchmarks: list[str], share: str = "pct_significant_improvement") -> DataFrame:
    """Plot-ready: one share with a metric label, of the named benchmarks."""
    label = F.when(F.col("metric") == "mse", "MSE").when(F.col("metric") == "absolute_error", "MAE").otherwise(F.upper("metric"))
    return summaries.where(F.col("benchmark_model").isin(benchmarks) & finite(share)).select("training_window", "benchmark_model", "metric", label.alias("metric_label"), F.col(share).alias("share"))


def ordered_sectors(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(value, "sector")))  # a row per sector
