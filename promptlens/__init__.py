"""Spark-native governance and analytics for AI-assistant prompt telemetry."""
