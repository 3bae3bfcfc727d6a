"""A Spark-native analytics engine: declarative lookups, datastores, similarity, series and reports."""
