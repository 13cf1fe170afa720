"""Relational operators over rule tables."""
