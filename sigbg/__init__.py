"""sigbg: signal-versus-background studies on Spark DataFrames."""

__version__ = "0.1.0"
