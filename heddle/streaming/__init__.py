"""Running versions of grouped summaries, for token streams."""
