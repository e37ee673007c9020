"""Operators of a training-data pipeline over crawled documents.

Nothing outside this folder (and ``corpus_pipeline.py``, ``tests/llm``) imports
it; ``__spark_entry__.py`` registers its queries when it is present.
"""
