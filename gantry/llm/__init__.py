"""Operators that prepare text for training corpora. Nothing outside this folder imports it."""
