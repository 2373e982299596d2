"""Operators for large text corpora: cleaning, duplicates, scoring, counting and packing."""
