"""Column functions: policy envelopes, result ordering, similarity."""
