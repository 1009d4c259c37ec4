"""A data-quality engine on Spark: profile, check, cleanse and keep a history of tables."""

__version__ = "0.1.0"
