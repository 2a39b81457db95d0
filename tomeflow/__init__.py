"""Preparing and querying long-document corpora on Spark."""
