"""Training-data operators: deduplication, packing, filters, tokenizing.  Nothing else in the package imports this."""
