"""Column expressions: draws, text rules, JSON rules, keyed digests."""
