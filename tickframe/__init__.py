"""tickframe: session telemetry on Spark DataFrames."""
