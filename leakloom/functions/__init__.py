"""Column-level building blocks: fixed catalogues, text helpers, digests."""
