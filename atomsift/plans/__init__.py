"""Stage flows and the query catalogue over the benchmark tables."""
