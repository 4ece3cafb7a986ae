"""Spark-native terrain analytics: grids, stamps, vector features and exports as DataFrames."""
