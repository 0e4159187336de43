"""Readers of corpora, labels and runs, and writers of results."""
