"""graphloom: analytics over typed knowledge graphs, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
