"""tessera: a property-graph query engine that compiles graph queries to Spark DataFrames."""

__version__ = "0.1.0"
