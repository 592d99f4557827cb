"""Training-data operators (packing, tokenising, de-duplication, extraction, search, filtering) on Spark."""
