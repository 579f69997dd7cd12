"""quarrylake: a PySpark-native analytics engine for source trees, text corpora and event logs."""
