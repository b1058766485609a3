"""Operators of large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the
repository top belongs to it.
"""
