"""Operators of the page-segmentation library."""
