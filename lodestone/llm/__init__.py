"""Operators for large text corpora used to train language models; nothing else in the library imports this folder."""
