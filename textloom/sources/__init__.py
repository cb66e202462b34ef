"""Readers of tokenizer definitions: tokenizer.json, SentencePiece models, byte ranks, trie vocabularies."""
