"""Operators for preparing training text: jobs over documents, conversations and vectors."""
