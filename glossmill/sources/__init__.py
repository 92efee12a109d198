"""Sources of the page-segmentation library."""
