"""Operators for training-data pipelines over ``documents``.

Nothing outside this subpackage imports it, so it can be removed as a whole
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
