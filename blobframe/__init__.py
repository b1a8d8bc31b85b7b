"""blobframe: content-addressed, versioned object data as Spark DataFrames."""

__version__ = "0.1.0"
