"""Quality checks of forecast tables. Every check is a table; raise_if_fatal stops a run on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.columns import all_finite, any_of, blank, clean, n_if, require
from volpanel.sources.steps import stored

NUMBERS = ("actual", "forecast", "error", "squared_error", "absolute_error", "qlike")
REQUIRED = ("ticker", "forecast_origin_date", "target_date", *NUMBERS)
METADATA = ("sector", "sector_etf", "market_ticker")
PAIR = ("ticker", "target_date")


def standard(forecasts: DataFrame) -> DataFrame:
    """Required columns as string, date and double; values that do not convert become NULL. ValueError for missing columns or no rows."""
    require(forecasts, REQUIRED)
    if forecasts.isEmpty():
        raise ValueError("the forecast table is empty")
    kinds = {"ticker": "string", "forecast_origin_date": "date", "target_date": "date"}
    return forecasts.withColumns({c: F.col(c).try_cast(kinds.get(c, "double")) for c in REQUIRED})


def missing_key() -> Column:
    return F.coalesce(F.col("ticker") == "", F.lit(True)) | F.col("forecast_origin_date").isNull() | F.col("target_date").isNull()


def nonfinite() -> Column:
    return ~all_finite(NUMBERS)


def expected() -> dict[str, Column]:
    e = F.col("actual") - F.col("forecast")
    return {"error": e, "squared_error": e * e, "absolute_error": F.abs(e), "qlike": F.exp(e) - e - 1}


def differences() -> dict[str, Column]:
    return {name: F.abs(F.col(name) - value) for name, value in expected().items()}


def mismatch(difference: Column, tolerance: float) -> Column:
    """A missing value counts as a mismatch."""
    return F.coalesce(F.isnan(difference) | (difference > tolerance), F.lit(True))


def nonfinite_rows(forecasts: DataFrame) -> DataFrame:
    return forecasts.where(nonfinite()).select(*REQUIRED)


def inconsistent_rows(forecasts: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    return forecasts.where(any_of(mismatch(d, tolerance) for d in differences().values())).select(*REQUIRED)


def duplicate_pairs(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy(*PAIR).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def distinct_or_null(*names: str) -> Column:
    """Distinct values, a missing one counting as a value."""
    return F.count_distinct(F.struct(*names))


def model_summary(forecasts: DataFrame, by: tuple[str, ...] = ("model",), tolerance: float = 1e-10) -> DataFrame:
    """One row per model: sizes, counts of faulty rows, largest differences. Two aggregates, the first of which counts pairs."""
    wrong = {n: mismatch(d, tolerance) for n, d in differences().items()}
    order = F.coalesce(F.col("forecast_origin_date") >= F.col("target_date"), F.lit(True))
    flags = {"n_missing_key_rows": missing_key(), "n_nonfinite_rows": nonfinite(), "n_invalid_date_order": order, "n_inconsistent_rows": any_of(wrong.values())} | {f"n_{n}_mismatch": w for n, w in wrong.items()}
    pairs = forecasts.groupBy(*by, *PAIR).agg(
        F.count("*").alias("n_rows"), *(n_if(c).alias(n) for n, c in flags.items()), *(F.max(clean(d)).alias(f"max_{n}_difference") for n, d in differences().items())
    )
    return pairs.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), distinct_or_null("ticker").alias("n_tickers"), distinct_or_null("target_date").alias("n_target_dates"),
        F.min("target_date").alias("first_target_date"), F.max("target_date").alias("last_target_date"), F.count("*").alias("n_ticker_date_pairs"),
        *(F.sum(n).alias(n) for n in flags), n_if(F.col("n_rows") > 1).alias("n_duplicate_pairs"), *(F.max(f"max_{n}_difference").alias(f"max_{n}_difference") for n in wrong),
    )


def _rows(df: DataFrame, keys: list[str], checks: list[tuple[str, Column, str, Column]]) -> DataFrame:
    """A row per check: name, status, severity, details."""
    made = F.array(*(F.struct(F.lit(n).alias("check_name"), s.alias("status"), F.lit(v).alias("severity"), d.alias("details")) for n, s, v, d in checks))
    return df.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*")


def _status(ok: Column, otherwise: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(otherwise)


def _text(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def model_checks(summary: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The check table of every model's summary; all of these are fatal."""
    # fixed values: consumers find checks by these names
    zero = lambda n, name, label: (name, _status(F.col(n) == 0), "fatal", _text(label, F.col(n)))
    checks = [
        ("Required columns", F.lit("PASS"), "fatal", F.lit("Columns all there")),
        zero("n_missing_key_rows", "Missing key values", "Rows lacking a key"),
        zero("n_nonfinite_rows", "Finite numerical values", "Rows with a number that is not finite"),
        zero("n_duplicate_pairs", "Duplicated ticker-date pairs", "Pairs met more than once"),
        zero("n_invalid_date_order", "Forecast origin before target date", "Rows whose origin is no earlier than the target"),
        zero("n_error_mismatch", "Error identity", "Error mismatches"),
        zero("n_squared_error_mismatch", "Squared error identity", "Squared error mismatches"),
        zero("n_absolute_error_mismatch", "Absolute error identity", "Absolute error mismatches"),
        zero("n_qlike_mismatch", "QLIKE identity", "QLIKE mismatches"),
    ]
    return _rows(summary, list(by), checks)


# ---- alignment of several models: one presence matrix serves all tests


def presence(forecasts: DataFrame, models: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """A row per (by, ticker, target_date): which models have it, once or more, and the ranges of actual and origin over them."""
    n = [n_if(F.col("model") == m) for m in models]
    return forecasts.groupBy(*by, *PAIR).agg(
        *(c.cast("boolean").alias(f"in_{i}") for i, c in enumerate(n)), *((c > 1).alias(f"again_{i}") for i, c in enumerate(n)), F.count_distinct("model").alias("n_models"), (F.max(clean("actual")) - F.min(clean("actual"))).alias("actual_range"),
        F.datediff(F.max("forecast_origin_date"), F.min("forecast_origin_date")).alias("origin_range_days"),
    )


def universe_summary(seen: DataFrame, models: list[str], reference: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, model, n, n_missing, n_extra) of the values of key ('ticker', 'target_date', or 'pair') against the reference model."""
    keys = list(PAIR) if key == "pair" else [key]
    one = seen.groupBy(*by, *keys).agg(*(F.bool_or(f"in_{i}").alias(f"in_{i}") for i in range(len(models))))
    ref = F.col(f"in_{models.index(reference)}")
    made = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"in_{i}").alias("here"), ref.alias("there")) for i, m in enumerate(models)))
    rows = one.select(*by, F.explode(made).alias("x")).select(*by, "x.*")
    return rows.groupBy(*by, "model").agg(n_if(F.col("here")).alias("n"), n_if(~F.col("here") & F.col("there")).alias("n_missing"), n_if(F.col("here") & ~F.col("there")).alias("n_extra"))


def universe_differences(seen: DataFrame, models: list[str], reference: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The members themselves: (by, model, key, kind) with kind missing or extra."""
    keys = list(PAIR) if key == "pair" else [key]
    one = seen.groupBy(*by, *keys).agg(*(F.bool_or(f"in_{i}").alias(f"in_{i}") for i in range(len(models))))
    ref = F.col(f"in_{models.index(reference)}")
    made = F.array(*(F.struct(F.lit(m).alias("model"), F.when(ref & ~F.col(f"in_{i}"), "missing").when(~ref & F.col(f"in_{i}"), "extra").alias("kind")) for i, m in enumerate(models)))
    return one.select(*by, *keys, F.explode(made).alias("x")).select(*by, *keys, "x.*").where("kind IS NOT NULL")


def common_panel(seen: DataFrame, n_models: int, tolerance: float = 1e-10, by: tuple[str, ...] = ()) -> DataFrame:
    """Common and union pairs, whether the common panel is balanced, and mismatches on common pairs."""
    common = F.col("n_models") == n_models
    pairs = seen.groupBy(*by).agg(
        n_if(common).alias("n_common_pairs"), F.count("*").alias("n_union_pairs"), n_if(common & (F.col("actual_range") > tolerance)).alias("n_actual_mismatches"),
        F.max(F.when(common, F.col("actual_range"))).alias("max_actual_difference"), n_if(common & (F.col("origin_range_days") > 0)).alias("n_origin_mismatches"),
        F.max(F.when(common, F.col("origin_range_days"))).alias("max_origin_difference_days"),
    )
    ins = [c for c in seen.columns if c.startswith("in_")]

    def in_all(key: str, name: str) -> DataFrame:
        one = seen.groupBy(*by, key).agg(*(F.bool_or(c).alias(c) for c in ins))
        every = F.col(ins[0])
        for c in ins[1:]:
            every = every & F.col(c)
        return one.groupBy(*by).agg(n_if(every).alias(name))

    tickers, dates = in_all("ticker", "n_common_tickers"), in_all("target_date", "n_common_target_dates")
    both = pairs.join(tickers, list(by)).join(dates, list(by)) if by else pairs.crossJoin(tickers).crossJoin(dates)  # one row each
    both = both.withColumn("expected_common_pairs", F.col("n_common_tickers") * F.col("n_common_target_dates"))
    return both.withColumn("common_panel_balanced", F.col("n_common_pairs") == F.col("expected_common_pairs"))


def mismatch_rows(forecasts: DataFrame, seen: DataFrame, n_models: int, tolerance: float = 1e-10, by: tuple[str, ...] = ()) -> DataFrame:
    """Forecast rows of common pairs whose actual values or origins differ between models."""
    bad = seen.where((F.col("n_models") == n_models) & ((F.col("actual_range") > tolerance) | (F.col("origin_range_days") > 0)))
    return forecasts.join(bad.select(*by, *PAIR), [*by, *PAIR], "left_semi")


def alignment_facts(seen: DataFrame, models: list[str], reference: str, tolerance: float = 1e-10, by: tuple[str, ...] = ()) -> DataFrame:
    """The numbers behind the check table, one row per value of by: tickers, dates and pairs are counted in one pass over their union."""
    ins = [f"in_{i}" for i in range(len(models))]
    key = lambda kind, ticker, date: F.struct(F.lit(kind).alias("kind"), ticker.cast("string").alias("k1"), date.cast("date").alias("k2"))
    ticker, date, nothing = F.col("ticker"), F.col("target_date"), F.lit(None)
    keys = F.array(key("ticker", ticker, nothing), key("target_date", nothing, date), key("pair", ticker, date))
    ranges = ("actual_range", "origin_range_days")
    keyed = seen.select(*by, *ins, *ranges, F.explode(keys).alias("key"))
    one = keyed.groupBy(*by, "key").agg(*(F.bool_or(i).alias(i) for i in ins), *(F.max(r).alias(r) for r in ranges))
    every = F.forall(F.array(*ins), lambda x: x)
    differ = sum(((F.col(i) != F.col(ins[models.index(reference)])).cast("int") for i in ins), F.lit(0))
    of = lambda kind: F.col("key.kind") == kind
    facts = one.groupBy(*by).agg(
        *(F.coalesce(F.sum(F.when(of(k), differ)), F.lit(0)).alias(f"n_{k}_differences") for k in ("ticker", "target_date", "pair")),
        n_if(of("pair") & every).alias("n_common_pairs"), n_if(of("ticker") & every).alias("n_common_tickers"), n_if(of("target_date") & every).alias("n_common_target_dates"),
        n_if(of("pair") & every & (F.col("actual_range") > tolerance)).alias("n_actual_mismatches"), n_if(of("pair") & every & (F.col("origin_range_days") > 0)).alias("n_origin_mismatches"),
    )
    facts = facts.withColumn("expected_common_pairs", F.col("n_common_tickers") * F.col("n_common_target_dates"))
    return facts.withColumn("common_panel_balanced", F.col("n_common_pairs") == F.col("expected_common_pairs"))


def alignment_checks(forecasts: DataFrame, models: list[str], reference: str, tolerance: float = 1e-10, by: tuple[str, ...] = (), rows_checked: bool = False) -> DataFrame:
    """The check table over all models; differing origins and an unbalanced panel only warn.

    rows_checked: single rows were found sound as they were written, so that of a model's own faults only repeated pairs are
    left, which the one pass over the pairs finds as well.
    """
    seen = presence(forecasts, models, by)
    if rows_checked:
        seen = stored(seen, "presence")
        again = [F.bool_or(f"again_{i}").cast("long") for i in range(len(models))]
        faulty = seen.groupBy(*by).agg(sum(again[1:], again[0]).alias("n_faulty_models"))
    else:
        single = model_summary(forecasts, (*by, "model"), tolerance)
        faults = sum((F.col(f"n_{c}") for c in ("missing_key_rows", "nonfinite_rows", "duplicate_pairs", "invalid_date_order", "inconsistent_rows")), F.lit(0))
        faulty = single.groupBy(*by).agg(n_if(faults > 0).alias("n_faulty_models"))
    key, parts = list(by), alignment_facts(seen, models, reference, tolerance, by)
    parts = parts.join(faulty, key) if key else parts.crossJoin(faulty)  # one row each
    none = lambda c: F.col(c) == 0
    # fixed values: consumers find checks by these names
    checks = [
        ("Individual model output checks", _status(none("n_faulty_models")), "fatal", _text("Models with faults", F.col("n_faulty_models"))),
        ("Same ticker universe", _status(none("n_ticker_differences")), "fatal", _text("Ticker differences", F.col("n_ticker_differences"))),
        ("Same target-date universe", _status(none("n_target_date_differences")), "fatal", _text("Date differences", F.col("n_target_date_differences"))),
        ("Same ticker-date universe", _status(none("n_pair_differences")), "fatal", _text("Pair differences", F.col("n_pair_differences"))),
        ("Non-empty common ticker-date panel", _status(F.col("n_common_pairs") > 0), "fatal", _text("Common ticker-date pairs", F.col("n_common_pairs"))),
        ("Actual values identical on common pairs", _status(none("n_actual_mismatches")), "fatal", _text("Actual mismatches", F.col("n_actual_mismatches"))),
        ("Forecast origins identical on common pairs", _status(none("n_origin_mismatches"), "WARNING"), "warning", _text("Forecast-origin mismatches", F.col("n_origin_mismatches"))),
        ("Balanced common panel", _status(F.col("common_panel_balanced"), "WARNING"), "warning", _text("Expected pairs", F.col("expected_common_pairs"))),
    ]
    return _rows(parts, key, checks)


# ---- metadata


def _distinct_known(c: str) -> Column:
    return F.count_distinct(F.when(~blank(c), F.col(c)))


def metadata_summary(forecasts: DataFrame, market: str, without: tuple[str, ...] = ("HAR",)) -> DataFrame:
    """(model, ...): missing values and tickers of several values; models named in `without` carry no metadata and get NULLs."""
    per = forecasts.groupBy("model", "ticker").agg(
        F.count("*").alias("n"), *(n_if(blank(c)).alias(f"m_{c}") for c in METADATA), *(_distinct_known(c).alias(f"d_{c}") for c in METADATA),
        n_if(~blank("market_ticker")).alias("known"), n_if(~blank("market_ticker") & (F.col("market_ticker") == market)).alias("as_expected"),
    )
    has = ~F.col("model").isin(list(without)) if without else F.lit(True)
    when = lambda c: F.when(has, c)
    out = per.groupBy("model").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_tickers"), *(F.sum(f"m_{c}").alias(f"n_missing_{c}") for c in METADATA),
        *(n_if(F.col(f"d_{c}") > 1).alias(f"n_tickers_multiple_{c}") for c in METADATA), ((F.sum("known") > 0) & (F.sum("known") == F.sum("as_expected"))).alias("market_ticker_expected"),
    )
    return out.select("model", has.alias("has_metadata"), "n_rows", "n_tickers", *(when(F.col(c)).alias(c) for c in out.columns if c.startswith("n_missing") or c.startswith("n_tickers_") or c.startswith("market")))


def metadata_values(forecasts: DataFrame, without: tuple[str, ...] = ("HAR",)) -> DataFrame:
    rows = forecasts.where(~F.col("model").isin(list(without))) if without else forecasts
    return rows.select("model", "ticker", *METADATA).distinct()


def metadata_mismatches(values: DataFrame) -> DataFrame:
    """Tickers with several known values of a column over the models."""
    n = values.groupBy("ticker").agg(*(_distinct_known(c).alias(f"n_unique_{c}") for c in METADATA))
    return n.where(any_of(F.col(f"n_unique_{c}") > 1 for c in METADATA))


def reference_mismatches(values: DataFrame, dimension: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Values unlike the dimension's first row of the ticker; both blank there is a mismatch, a NULL comparison is none."""
    from volpanel.sources.bars import first_rows

    ref = first_rows(dimension, ["ticker"], order or ["sector", "sector_etf"]).select("ticker", F.col("sector").alias("ref_sector"), F.col("sector_etf").alias("ref_sector_etf"))
    rows = values.join(ref, "ticker", "left")
    unknown = blank("ref_sector") & blank("ref_sector_etf")
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"ref_{c}"), F.lit(False))
    return rows.where(unknown | differs("sector") | differs("sector_etf"))


def reference_duplicates(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("ticker").agg(F.count("*").alias("n")).where("n > 1")


def metadata_checks(forecasts: DataFrame, dimension: DataFrame, market: str, without: tuple[str, ...] = ("HAR",)) -> DataFrame:
    """The check table of the metadata; the comparison with the dimension warns even when it fails."""
    values = metadata_values(forecasts, without)
    total = metadata_summary(forecasts, market, without).agg(
        n_if(F.col("has_metadata")).alias("n_models"), *(F.coalesce(F.sum(sum((F.coalesce(F.col(f"{p}_{c}"), F.lit(0)) for c in METADATA), F.lit(0))), F.lit(0)).alias(p) for p in ("n_missing", "n_tickers_multiple")),
        F.coalesce(F.bool_and("market_ticker_expected"), F.lit(True)).alias("market_ok"),
    )
    counts = {"n_across": metadata_mismatches(values), "n_reference": reference_mismatches(values, dimension), "n_double": reference_duplicates(dimension)}
    for name, df in counts.items():
        total = total.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    none = lambda c: F.col(c) == 0
    # fixed values: consumers find checks by these names
    checks = [
        ("Metadata available in at least one model", _status(F.col("n_models") > 0, "WARNING"), "warning", _text("Models that carry metadata", F.col("n_models"))),
        ("No missing metadata values", _status(none("n_missing")), "fatal", _text("Values missing", F.col("n_missing"))),
        ("Unique metadata per ticker within each model", _status(none("n_tickers_multiple")), "fatal", _text("Tickers of several values", F.col("n_tickers_multiple"))),
        ("Expected market ticker", _status(F.col("market_ok")), "fatal", F.lit(f"Market: {market}")),
        ("Metadata consistent across models", _status(none("n_across")), "fatal", _text("Tickers on which models differ", F.col("n_across"))),
        ("Metadata consistent with reference table", _status(none("n_reference") & none("n_double")), "warning", _text("Rows unlike the dimension", F.col("n_reference"))),
    ]
    return _rows(total, [], checks)


def row_metrics(tolerance: float = 1e-10) -> dict[str, Column]:
    """Counts of faulty rows that a write can observe as it goes, by the names of model_summary."""
    order = F.coalesce(F.col("forecast_origin_date") >= F.col("target_date"), F.lit(True))
    flags = {"n_missing_key_rows": missing_key(), "n_nonfinite_rows": nonfinite(), "n_invalid_date_order": order}
    flags |= {f"n_{n}_mismatch": mismatch(d, tolerance) for n, d in differences().items()}
    return {"n_rows": F.count(F.lit(1))} | {name: n_if(c) for name, c in flags.items()}


def raise_if_observed(metrics: dict[str, int]) -> None:
    """ValueError if a table was empty as it was written, or naming the counts of row_metrics that are not zero."""
    if not metrics["n_rows"]:
        raise ValueError("the forecast table is empty")
    faults = {n: v for n, v in metrics.items() if n != "n_rows" and v}
    if faults:
        raise ValueError("; ".join(f"{n}: {v}" for n, v in faults.items()))


def raise_if_fatal(checks: DataFrame) -> None:
    """ValueError naming fatal checks that failed; a check table has a few rows."""
    failed = [r.asDict() for r in checks.where("status = 'FAIL' AND severity = 'fatal'").collect()]
    if failed:
        raise ValueError("; ".join(f"{r['check_name']} ({r['details']})" for r in failed))
