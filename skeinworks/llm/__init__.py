"""Corpus preparation for language-model training; nothing outside this package imports it."""
