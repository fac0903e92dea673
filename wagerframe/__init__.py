"""Spark-native operators for tables of lottery choices and free-text answers."""
