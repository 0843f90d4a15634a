"""Training-data operators: extraction, near duplicates, scoring, packing, fingerprints.

Of the rest of the package only `operators/passages.py` imports it, for the word hashes.
"""
