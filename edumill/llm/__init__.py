"""Operators that prepare text and records for training language models; nothing outside imports this subpackage."""
