"""Operators that prepare text corpora for language-model training, one module per operator."""
