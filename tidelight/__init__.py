"""tidelight: a PySpark-native analytics engine for time-ordered event data."""

__version__ = "0.1.0"
