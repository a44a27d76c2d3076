"""A PySpark-native engine that condenses and measures text corpora."""
