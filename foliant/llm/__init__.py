"""Training-data operators: token counts, packing, filtering, extraction and deduplication.

Nothing outside this package imports it.
"""
