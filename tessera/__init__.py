"""Spark-native analytics for placing directed networks on router-tree hardware."""
