"""Operators over long (document, clause) and (document, term) tables."""
