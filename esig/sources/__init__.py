"""Reading, writing and viewing tables."""
