"""blockloom: disk-image metadata and page text as Spark relations."""

__version__ = "0.1.0"
