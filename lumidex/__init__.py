"""Lumidex: media-library analytics on Spark."""
