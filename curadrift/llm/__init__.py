"""Operators for training data: tokens, repeats, near copies, quality, language, private data, packing, search."""
