"""Training-data operators: deduplication, mixing, packing, quality, search, counting, scanning.

Nothing outside this folder imports it; ``registry`` holds its queries.
"""
