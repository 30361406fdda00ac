"""Operations on text and vector corpora: filters, deduplication, search, mixing and packing.

Nothing outside this package imports it.
"""
