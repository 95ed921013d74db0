"""Part of the search engine."""
