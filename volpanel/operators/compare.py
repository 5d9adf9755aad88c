"""Loss tables over models and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import blank, clean, finite

from . import checks

LOSSES = {"mse": "squared_error", "mae": "absolute_error", "qlike": "qlike"}
KEYS = ("training_window", "rv_interval_minutes", "model")
MODELS = ("HAR", "HAR-X", "RELATIVE")


def loss_panel(outputs: dict[str, DataFrame], dimension: DataFrame, rv_interval_minutes: int) -> DataFrame:
    """All models' forecasts as one long table; models without a sector get it by ticker."""
    sectors = dimension.select("ticker", F.col("sector").alias("__sector")).dropDuplicates(["ticker"])
    parts = None
    for name, df in outputs.items():
        part = df.withColumn("model", F.lit(name))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    if "sector" not in parts.columns:
        parts = parts.withColumn("sector", F.lit(None).cast("string"))
    rows = parts.join(F.broadcast(sectors), "ticker", "left").withColumn("sector", F.coalesce("sector", "__sector")).drop("__sector")  # a row per ticker
    return rows.withColumn("rv_interval_minutes", F.lit(rv_interval_minutes))


def ticker_losses(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*KEYS, "ticker", "sector").agg(*(F.avg(clean(c)).alias(n) for n, c in LOSSES.items()), F.count("*").alias("n_forecasts"))


def _means(by_ticker: DataFrame, *keys: str) -> DataFrame:
    return by_ticker.groupBy(*keys).agg(*(F.avg(clean(n)).alias(n) for n in LOSSES), F.count_distinct("ticker").alias("n_tickers"), F.sum("n_forecasts").alias("n_forecasts"))


def overall_losses(by_ticker: DataFrame) -> DataFrame:
    """Means of ticker means, so that every ticker weighs alike."""
    return _means(by_ticker, *KEYS)


def sector_losses(by_ticker: DataFrame) -> DataFrame:
    return _means(by_ticker, *KEYS, "sector")


def observed(panel: DataFrame, tolerance: float = 1e-10) -> tuple[DataFrame, Observation]:
    """panel with counts of its faulty rows that come with the pass that writes it; ValueError for missing columns."""
    seen = Observation()
    return checks.require(panel, checks.REQUIRED).observe(seen, *(c.alias(n) for n, c in checks.row_metrics(tolerance).items())), seen


def checked(panel: DataFrame, models: list[str], dimension: DataFrame, market: str, reference: str = "HAR", tolerance: float = 1e-10) -> DataFrame:
    """panel, whose rows were checked as they were written, or ValueError at a fatal failure of alignment or metadata; all training windows together."""
    checks.raise_if_fatal(checks.alignment_checks(panel, models, reference, tolerance, ("training_window",), rows_checked=True))
    checks.raise_if_fatal(checks.metadata_checks(panel, dimension, market))
    return panel


def loss_curves(losses: DataFrame) -> DataFrame:
    """Plot-ready: one row per metric with its label, finite losses, sectors that are not blank."""
    rows = losses.where(~blank("sector")) if "sector" in losses.columns else losses
    ids = [c for c in rows.columns if c not in LOSSES]
    long = rows.unpivot(ids, list(LOSSES), "metric", "loss")
    label = F.when(F.col("metric") == "mse", "MSE").when(F.col("metric") == "mae", "MAE").otherwise("QLIKE")
    return long.where(finite("loss")).withColumn("metric_label", label)


def reduction_table(by_sector: DataFrame, windows: tuple[int, ...] = (100, 400, 800), base: str = "HAR") -> DataFrame:
    """(sector, model, one column per metric and window): percentage of loss below the base model's, two digits."""
    keys = Window.partitionBy("training_window", "rv_interval_minutes", "sector")
    of_base = lambda n: F.max(F.when(F.col("model") == base, F.col(n))).over(keys)
    rows = by_sector.where(F.col("training_window").isin(list(windows)))
    rows = rows.select("sector", "model", "training_window", *(F.try_divide(100 * (of_base(n) - F.col(n)), of_base(n)).alias(n) for n in LOSSES)).where(F.col("model") != base)
    long = rows.unpivot(["sector", "model", "training_window"], list(LOSSES), "metric", "value")
    long = long.select("sector", "model", F.concat(F.upper("metric"), F.lit(" training = "), F.col("training_window").cast("string")).alias("column_name"), F.round("value", 2).alias("value"))
    columns = [f"{n.upper()} training = {w}" for w in windows for n in LOSSES]
    return long.groupBy("sector", "model").pivot("column_name", columns).agg(F.first("value", ignorenulls=True)).orderBy("sector", "model")
