"""Read-alignment analytics on Spark DataFrames."""

VERSION = "0.1.0"
