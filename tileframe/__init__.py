"""Images to palettes, tilesets and tile maps, as DataFrame operations."""
