"""Graphloom: analytics over typed software graphs, expressed as Spark plans."""

__version__ = "0.1.0"
