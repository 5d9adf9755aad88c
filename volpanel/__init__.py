"""From a panel of intraday prices to evaluated volatility forecasts, as Spark jobs on long DataFrames."""
