"""loomgraph: a Spark-native knowledge-graph recall, consolidation and data-quality engine."""

__version__ = "0.1.0"
