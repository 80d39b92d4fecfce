"""Operators over text corpora for training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin contract queries, ``scratch`` and ``ranks`` hold
what the operators share.
"""
