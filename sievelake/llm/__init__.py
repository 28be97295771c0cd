"""Training-data operators: filters, de-duplication, packing and formatting of text corpora on Spark."""
