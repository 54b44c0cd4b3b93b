"""Lectern: Spark-native operators for long-form text, narration scripts and audio segments."""
