"""Training-data operators: tokenisation, filtering, near-duplicate detection and packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
