"""DataFrame operators: traversal, merging, dedup, coverage, gates, diffs."""
