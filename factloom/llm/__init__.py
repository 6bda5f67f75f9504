"""Training-data operators: filtering, deduplication, sharding, tokenising and sanitising text at corpus scale.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
