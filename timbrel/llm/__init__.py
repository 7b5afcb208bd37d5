"""Training-data operators: mixing, filtering, search, de-duplication, packing."""
