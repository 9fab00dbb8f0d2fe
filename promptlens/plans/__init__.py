"""Reports over the curated table."""
