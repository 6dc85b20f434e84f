"""Spark-native surface-wear analytics on triangle meshes."""
