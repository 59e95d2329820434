"""functions of the image conversion."""
