"""Operators for large training-data corpora. Import the modules one by one; this file stays empty on purpose."""
