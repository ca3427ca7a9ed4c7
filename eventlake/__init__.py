"""Spark-native security-event analytics: envelope, normalise, detect, coerce, route, store, triage."""
