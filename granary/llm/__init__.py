"""Training-data operators at corpus scale (deduplication, packing, scoring, sharding).

Nothing else in the library imports this subpackage.
"""
