"""Operators for building training data from very large document collections.

Nothing outside this package and ``corpus_pipeline.py`` imports it, so it can
be removed together with its tests without touching the raster engine.
"""
