"""Spark-native terrain analytics over gridded elevation data and point clouds."""
