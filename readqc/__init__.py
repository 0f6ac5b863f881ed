"""readqc: quality-control analytics over sequencing reads, as Spark DataFrames."""

__version__ = "0.1.0"
