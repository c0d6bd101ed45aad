"""Query catalogue of the library's own operators."""
