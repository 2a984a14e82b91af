"""loomgraph.streaming"""
