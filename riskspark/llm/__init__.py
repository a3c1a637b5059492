"""Operators for large text corpora: tokens, packing, classifiers, duplicates, search, licences, chats."""
