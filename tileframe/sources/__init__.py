"""sources of the image conversion."""
