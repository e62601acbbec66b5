"""Column functions: lookups, tokens, patterns, SQL names."""
