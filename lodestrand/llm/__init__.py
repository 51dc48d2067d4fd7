"""Training-data operators: decontamination, filters, near-duplicate search, packing, sharding, language and licence scans."""
