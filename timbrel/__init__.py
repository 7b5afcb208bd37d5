"""Timed-text and catalogue analytics on Spark."""
