"""Versioned-record analytics on Spark: an append-only mutation log resolved by last writer wins."""
