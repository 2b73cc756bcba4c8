"""Training-data operators: near-duplicates, private data, vector search, scoring, filtering, formatting and mixing."""
