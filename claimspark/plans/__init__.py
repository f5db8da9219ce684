"""Named queries with equal SQL, by subject."""
