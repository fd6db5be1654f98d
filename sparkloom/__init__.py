"""A PySpark-native analytics engine for task bundles, near-duplicates, findings, object stores and ledgers."""

__version__ = "0.2.0"
