"""mailspark: mail-archive and usage-log analytics on Spark DataFrames."""

__version__ = "0.1.0"
