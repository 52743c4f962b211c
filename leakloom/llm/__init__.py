"""Operators that prepare training corpora: quality, duplicates, filters, mixing, packing, search."""
