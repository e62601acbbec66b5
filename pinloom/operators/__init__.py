"""DataFrame and column operators of romanization, matching and dictionary tables."""
