"""Streaming: nothing to build.

The matcher has no stream, watermark, window or state.  Its row-level stages — URL
normalization, vector parsing, row filter reasons, pattern split, text building, main text —
are plain column expressions and run unchanged on a streaming DataFrame
(``spark.readStream…``); language sets, dedupe, similarity and assignment are whole-set
operators and stay batch jobs.
"""
