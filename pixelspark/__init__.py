"""pixelspark: event data of pixel detectors as Spark DataFrames."""

__version__ = "0.1.0"
