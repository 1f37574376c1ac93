"""A versioned, keyed change-log table engine expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
