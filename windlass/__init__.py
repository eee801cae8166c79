"""Spark-native analytics over transaction logs: windows, features, graphs, detectors, evaluation."""
