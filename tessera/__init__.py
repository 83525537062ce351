"""Spark-native analytics over event tables: information measures, held-out scoring, resampling and audits."""
