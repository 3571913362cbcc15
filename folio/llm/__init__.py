"""Corpus-preparation operators for language-model training data.

Nothing outside this folder imports it: the rest of the package works without it.
"""
