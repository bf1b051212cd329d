"""treeline: analytics over repository indexes and document collections, as Spark plans."""
