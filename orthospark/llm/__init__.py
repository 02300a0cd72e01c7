"""Operators of a training-data pipeline over document tables.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` in
:mod:`orthospark.llm.queries` are what the entry module adds when it is present.
"""
