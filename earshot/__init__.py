"""Soundscape analytics on Spark."""
