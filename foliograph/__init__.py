"""Spark-native page-layout and corpus analytics."""
