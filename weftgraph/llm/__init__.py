"""Training-data operators: quality, dedup, decontamination, secrets, packing, archives."""
