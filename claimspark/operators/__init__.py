"""Pure functions from DataFrame to DataFrame, by subject."""
