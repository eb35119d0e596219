"""Operators for language-model training data (documents, pages, embeddings,
conversations). Nothing outside this folder imports it except the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
