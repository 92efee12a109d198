"""Functions of the page-segmentation library."""
