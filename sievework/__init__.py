"""sievework: curation, splitting, evaluation and ensembling of labelled tables on PySpark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
