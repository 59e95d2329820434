"""plans of the image conversion."""
