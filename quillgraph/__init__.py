"""Spark-native analytics over article-repository graphs."""
