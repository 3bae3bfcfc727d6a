"""Readers, archives and partitioned datastores."""
