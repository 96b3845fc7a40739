"""Spark-native functional signal analytics: penalised splines, functional PCA and group discrimination."""
