"""Operators for large training corpora: quality, duplicates, secrets, packing, mixing, language, licences, urls."""
