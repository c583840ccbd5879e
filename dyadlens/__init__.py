"""Spark-native engine for paired audits of free-text judgements."""
