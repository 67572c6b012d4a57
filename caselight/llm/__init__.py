"""Operators that prepare text corpora and vectors for language-model training."""
