"""tidewater: a small analytics engine on top of Spark's DataFrame, SQL and Data Source APIs."""

__version__ = "0.1.0"
