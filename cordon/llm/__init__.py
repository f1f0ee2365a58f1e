"""Training-data operators: dedup, quality, decontamination, mixing, language and licence scans."""
