"""Probeforge: Spark-native construction and analysis of visual question-answering evaluation data."""
