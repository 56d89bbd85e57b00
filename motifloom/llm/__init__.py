"""Operators for large text corpora that feed language-model training.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` in
:mod:`motifloom.llm.catalog` are what the entry module adds when it is present.
"""
