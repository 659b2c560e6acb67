"""Corpus operators: near duplicates, tokens, packing, fingerprints, chat, search, shards, scoring, language, mixing."""
