"""Compositions of operators, and the queries registered over the supplied tables."""
