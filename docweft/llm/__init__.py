"""Operators for building training corpora: deduplication, decontamination, scoring, mixing, media."""
