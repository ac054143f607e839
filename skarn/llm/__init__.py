"""Operators for preparing language-model training data, each usable alone or in corpus_pipeline."""
