"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it; the folder can be deleted together
with ``corpus_pipeline.py`` and ``tests/llm``.
"""
