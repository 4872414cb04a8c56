"""Operators of a training-data pipeline: filtering, deduplication, decontamination, mixing, sharding, formatting, output.

Every operator takes and returns DataFrames; ``queries`` registers one query per operator. Nothing outside this
subpackage (but ``corpus_pipeline.py``) imports it.
"""
