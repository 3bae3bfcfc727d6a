"""Table declarations, lookups and the query layer."""
