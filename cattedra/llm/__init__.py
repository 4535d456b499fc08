"""Training-data operators (BPE, dedup, scoring, search, mixing, token files). Nothing else in the library imports this."""
