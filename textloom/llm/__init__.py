"""Operators of a training-data pipeline over tables of texts.

Every operator takes and returns DataFrames. Operators that have to look things up globally (token ranks, shingle
frequencies, word counts, repeated passages) share one shape, see :mod:`textloom.llm.packed`: texts are packed once into
compressed chunks in the shared folder, each chunk sends its *distinct* keys to hash buckets, each bucket answers every chunk,
and the chunk joins the answers back by position.
"""
