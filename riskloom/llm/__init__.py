"""Training-data operators: quality rules, near-dedup, decontamination, mixing, scoring, encoding, sharding.

Nothing outside this package imports it, except the guarded hook in ``__spark_entry__.py``.
"""
