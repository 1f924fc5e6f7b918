"""Operators of a training-data pipeline: duplicates, tokens, archives, chats, classifiers."""
