"""Entity matching and corpus analytics as declarative Spark plans."""
