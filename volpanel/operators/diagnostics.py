"""Out-of-sample R squared of components, and the decomposition of the squared forecast error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.columns import INFINITY, all_finite, blank, finite, share

from volpanel.sources.steps import stored

from .significance import ordered_sectors


def r2_table(panel: DataFrame) -> DataFrame:
    """(training_window, component, ticker, sector, n_forecasts, msfe_har, msfe_baseline, r2_oos)."""
    rows = panel.where(finite("squared_error_har") & finite("squared_error_baseline") & (F.col("squared_error_baseline") >= 0))
    out = rows.groupBy("training_window", "component", "ticker", "sector").agg(F.count("*").alias("n_forecasts"), F.avg("squared_error_har").alias("msfe_har"), F.avg("squared_error_baseline").alias("msfe_baseline"))
    return out.withColumn("r2_oos", F.when(F.col("msfe_baseline") > 0, 1 - F.try_divide("msfe_har", "msfe_baseline")))


def component_summary(r2: DataFrame) -> DataFrame:
    rows = r2.where(finite("r2_oos"))
    return rows.groupBy("training_window", "component").agg(
        F.count_distinct("ticker").alias("n_tickers"), F.avg("r2_oos").alias("mean_r2_oos"), F.median("r2_oos").alias("median_r2_oos"), share(F.col("r2_oos") > 0).alias("pct_positive_r2_oos")
    )


def paired(r2: DataFrame) -> DataFrame:
    """Residual against stock per ticker; ValueError if one of the two components is absent."""
    names = ["stock_log_rv", "relative_q"]
    if r2.where(F.col("component").isin(names)).select("component").distinct().count() < 2:
        raise ValueError(f"the table must hold {' and '.join(names)}")
    wide = r2.groupBy("training_window", "ticker", "sector").pivot("component", names).agg(F.first("r2_oos", ignorenulls=True))
    return wide.withColumn("delta_r2_q_vs_stock", F.col("relative_q") - F.col("stock_log_rv")).where(finite("delta_r2_q_vs_stock"))


def sector_comparison(pairs: DataFrame) -> DataFrame:
    d = F.col("delta_r2_q_vs_stock")
    return (
        pairs.groupBy("training_window", "sector")
        .agg(
            F.count_distinct("ticker").alias("n_tickers"), F.avg("stock_log_rv").alias("mean_stock_r2_oos"), F.avg("relative_q").alias("mean_q_r2_oos"),
            F.avg(d).alias("mean_delta_r2"), F.median(d).alias("median_delta_r2"), share(d > 0).alias("pct_positive_delta"),
        )
        .orderBy("mean_delta_r2")
    )


def r2_to_plot(r2: DataFrame) -> DataFrame:
    """Plot-ready: per sector the medians of fund components and of stocks, one market median, and the sectors' order by stocks."""
    rows = r2.where(finite("r2_oos") & ~blank("sector"))
    median = lambda c: F.median(F.when(F.col("component") == c, F.col("r2_oos")))
    by = rows.groupBy("sector").agg(median("stock_log_rv").alias("median_stock_r2"), median("sector_perp").alias("median_sector_perp_r2"), median("sector_etf_log_rv").alias("median_sector_etf_r2"))
    market = rows.agg(median("market_log_rv").alias("median_market_r2"))
    return ordered_sectors(by.crossJoin(F.broadcast(market)), "median_stock_r2")  # one row


TERMS = ("market_squared_term", "sector_squared_term", "q_squared_term", "market_sector_cross_term", "market_q_cross_term", "sector_q_cross_term")
NEEDED = ("final_error", "market_error_contribution", "sector_error_contribution", "q_error_contribution", "reconstructed_error", "final_squared_error", *TERMS)


def _actuals(panel: DataFrame, key: str, name: str) -> DataFrame:
    return panel.select(F.col("ticker").alias(key), F.col("date").alias("target_date"), F.col("log_rv").alias(name), F.lit(True).alias(f"has_{name}"))


def error_decomposition(forecasts: DataFrame, panel: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Row by row, the forecast error of the component model as weighted errors of market, fund and residual, their squares and cross terms.

    ValueError if a target date is missing from the panel, a stored actual value differs from it, or the parts do not add up. A
    date at which market or fund have no value gives no row.
    """
    rows = forecasts
    for key, name in (("ticker", "stock_actual"), ("market_ticker", "market_actual"), ("sector_etf", "sector_actual_raw")):
        rows = rows.join(_actuals(panel, key, name), [key, "target_date"], "left")
    c = F.col
    rows = rows.withColumns({"final_error": c("actual") - c("forecast"), "market_error": c("market_actual") - c("market_forecast"), "stored_error": c("error"), "stock_forecast": c("forecast")})
    rows = rows.withColumn("sector_perp_actual", c("sector_actual_raw") - (c("sector_intercept_hat") + c("sector_beta_market_hat") * c("market_actual")))
    rows = rows.withColumn("q_actual", c("stock_actual") - (c("alpha_hat") + c("beta_market_hat") * c("market_actual") + c("beta_sector_hat") * c("sector_perp_actual")))
    rows = rows.withColumns({"sector_perp_error": c("sector_perp_actual") - c("sector_perp_forecast"), "q_error": c("q_actual") - c("q_forecast")})
    rows = rows.withColumns({"market_error_contribution": c("beta_market_hat") * c("market_error"), "sector_error_contribution": c("beta_sector_hat") * c("sector_perp_error"), "q_error_contribution": c("q_error")})
    m, s, q = c("market_error_contribution"), c("sector_error_contribution"), c("q_error_contribution")
    rows = rows.withColumn("reconstructed_error", m + s + q).withColumn("reconstruction_difference", c("reconstructed_error") - c("final_error"))
    rows = rows.withColumns({
        "final_squared_error": c("final_error") * c("final_error"), "reconstructed_squared_error": c("reconstructed_error") * c("reconstructed_error"), "market_squared_term": m * m,
        "sector_squared_term": s * s, "q_squared_term": q * q, "market_sector_cross_term": 2 * m * s, "market_q_cross_term": 2 * m * q, "sector_q_cross_term": 2 * s * q,
    })
    rows = stored(rows, "error-decomposition")  # tested and returned
    largest = lambda d: F.max(F.when(F.abs(d) < INFINITY, F.abs(d)))
    missing, actual, parts = rows.agg(F.count_if(c("has_stock_actual").isNull()), largest(c("stock_actual") - c("actual")), largest(c("reconstruction_difference"))).first()
    if missing:
        raise ValueError(f"{missing} target dates are not in the panel")
    if (actual or 0) > tolerance:
        raise ValueError(f"stored actual values differ from the panel by up to {actual}")
    if (parts or 0) > tolerance:
        raise ValueError(f"component errors do not add up to the stored error: {parts}")
    names = [
        "ticker", "sector", "sector_etf", "market_ticker", "forecast_origin_date", "target_date", "stock_actual", "stock_forecast", "final_error", "stored_error", "market_actual", "market_forecast",
        "market_error", "sector_actual_raw", "sector_perp_actual", "sector_perp_forecast", "sector_perp_error", "q_actual", "q_forecast", "q_error", "alpha_hat", "beta_market_hat", "beta_sector_hat",
        "sector_intercept_hat", "sector_beta_market_hat", "market_error_contribution", "sector_error_contribution", "q_error_contribution", "reconstructed_error", "reconstruction_difference",
        "final_squared_error", "reconstructed_squared_error", *TERMS,
    ]
    return rows.where(all_finite(NEEDED)).select(*names)


def decomposition_summary(rows: DataFrame) -> DataFrame:
    """Pooled means of all terms by sector, totals and shares of the final error; blank sectors are dropped."""
    good = rows.where(all_finite([n for n in NEEDED] + ["reconstructed_squared_error", "reconstruction_difference"]) & ~blank("sector"))
    names = dict(zip(TERMS, ("market_squared_component", "sector_squared_component", "q_squared_component", "market_sector_cross_component", "market_q_cross_component", "sector_q_cross_component"), strict=True))
    out = good.groupBy("sector").agg(
        F.count_distinct("ticker").alias("n_tickers"), F.count("*").alias("n_forecasts"), F.avg("final_squared_error").alias("final_msfe"), F.avg("reconstructed_squared_error").alias("reconstructed_msfe"),
        *(F.avg(t).alias(n) for t, n in names.items()), F.max(F.abs("reconstruction_difference")).alias("max_abs_reconstruction_difference"),
    )
    c = F.col
    squares = c("market_squared_component") + c("sector_squared_component") + c("q_squared_component")
    crosses = c("market_sector_cross_component") + c("market_q_cross_component") + c("sector_q_cross_component")
    out = out.withColumn("total_squared_component", squares).withColumn("total_cross_component", crosses).withColumn("total_decomposed_msfe", squares + crosses)
    out = out.withColumn("decomposition_gap", c("total_decomposed_msfe") - c("final_msfe"))

    def of_final(x: str) -> Column:
        return F.when(c("final_msfe") > 0, 100 * F.try_divide(c(x), c("final_msfe")))

    shares = {"market_squared_share_pct": "market_squared_component", "sector_squared_share_pct": "sector_squared_component", "q_squared_share_pct": "q_squared_component", "total_cross_share_pct": "total_cross_component"}
    return out.withColumns({n: of_final(x) for n, x in shares.items()}).orderBy("total_cross_component")


def shares_to_plot(summary: DataFrame) -> DataFrame:
    """Plot-ready: market, fund and residual share per sector with labels; sectors in the order of their cross share."""
    labels = {"market_squared_share_pct": "Market", "sector_squared_share_pct": "Sector", "q_squared_share_pct": "Residual"}
    rows = ordered_sectors(summary.where(all_finite([*labels, "total_cross_share_pct"])), "total_cross_share_pct")
    long = rows.unpivot(["sector", "place", "total_cross_share_pct"], list(labels), "part", "share_pct")
    label = F.when(F.col("part") == "market_squared_share_pct", "Market").when(F.col("part") == "sector_squared_share_pct", "Sector").otherwise("Residual")
    return long.withColumn("label", label)
