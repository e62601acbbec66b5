"""Spark-native Chinese romanization and pinyin search."""
