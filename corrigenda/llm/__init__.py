"""Training-data operators: token counts, near-duplicates, quality, extraction, packing.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
