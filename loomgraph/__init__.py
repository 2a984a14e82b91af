"""loomgraph: graph, data-quality and text analytics as PySpark DataFrame operators."""
