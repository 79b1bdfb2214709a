"""Operators that prepare text corpora for training; nothing outside this package imports it."""
