"""operators of the image conversion."""
