"""Pipeline telemetry, metric series and sensor streams as Spark DataFrames."""

__version__ = "0.1.0"
