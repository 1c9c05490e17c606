"""Lectern: search, ranking and summarization of text documents as Spark plans."""
