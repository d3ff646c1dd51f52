"""Lexicon analytics on Spark: dictionary corpora, lookup tables and search."""
