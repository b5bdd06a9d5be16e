"""Versioned key/value analytics on Spark: a mutation log, last-writer-wins state and sorted runs."""
