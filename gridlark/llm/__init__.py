"""Training-data operators: WARC, ANN, language id, URL filters, deduplication, quality, sharding, decontamination, BPE."""
