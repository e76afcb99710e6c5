"""Operators for building training corpora: deduplication, tokenising, mixing, scanning, scoring."""
