"""Operations for large training-data pipelines.

Nothing outside this folder imports it, and it imports nothing of the rest of
the library.  ``llm_queries`` registers one query per operator.
"""
