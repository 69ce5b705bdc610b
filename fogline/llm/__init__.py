"""Operators for building training corpora; nothing else in fogline imports this subpackage."""
