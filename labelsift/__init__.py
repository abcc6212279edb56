"""labelsift: find, measure and correct wrong labels in Spark tables."""

__version__ = "0.1.0"
