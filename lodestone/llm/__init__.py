"""Training-data operators: fingerprints, classifiers, archives, near-duplicates, packing, search, tokens."""
