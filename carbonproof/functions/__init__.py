"""Column functions: canonical encodings and digests."""
