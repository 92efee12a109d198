"""Streaming of the page-segmentation library."""
