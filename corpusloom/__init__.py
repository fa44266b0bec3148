"""Corpus construction and corpus analytics as Spark plans."""
