"""Training-data operators: filtering, deduplication, decontamination, packing.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
