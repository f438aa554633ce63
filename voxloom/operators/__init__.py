"""Operators on labelled points, scene graphs, descriptors and poses."""
