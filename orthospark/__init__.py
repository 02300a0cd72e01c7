"""Distributed analytics over raster tiles, their labels and their anomaly scores."""
