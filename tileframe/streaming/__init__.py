"""streaming of the image conversion."""
