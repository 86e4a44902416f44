"""rowloom: step-oriented statistical programs, compiled to Spark DataFrames."""

__version__ = "0.2.0"
