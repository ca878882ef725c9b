"""Training-data operators: sharding, toxicity, mixing, dedup, encoding, URL rules, binary output, media and quality."""
