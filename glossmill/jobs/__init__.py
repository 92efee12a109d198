"""Jobs of the page-segmentation library."""
