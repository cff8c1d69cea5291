"""tarnlight: time-series and telemetry analytics on Spark DataFrames."""
