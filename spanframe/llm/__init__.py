"""Training-data operators over DataFrames of documents, pages and conversations.

Nothing outside this package imports it; `registry.py` lists its queries.
"""
