"""Operators on cell, tile, score and run tables: DataFrames in, DataFrames out."""
