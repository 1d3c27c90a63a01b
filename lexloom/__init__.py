"""Lexical-semantic retrieval over text collections, as lazy DataFrame operators."""
