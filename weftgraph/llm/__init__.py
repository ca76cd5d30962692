"""Training-data operators: text cleaning, deduplication, packing and formatting."""
