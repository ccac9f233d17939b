"""Relational operators shared by the audit plans."""
