"""Training-data operators over document tables.

Self-contained: nothing else in the library imports this subpackage, and its
queries are registered by ``ckptlake.llm.registry``.
"""
