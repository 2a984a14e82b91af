"""loomgraph.sources"""
