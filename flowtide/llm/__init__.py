"""Operators for building training corpora: deduplication, decontamination, scoring, extraction, tokenization."""
