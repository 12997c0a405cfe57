"""Corpus, graph and architecture analytics as Spark jobs."""
