"""Whole plans: the driver tables as a graph, and the registered queries."""
