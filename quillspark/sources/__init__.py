"""Readers of landed records: eight bibliographic sources, the CSV corpus, BibTeX, and files by suffix."""
