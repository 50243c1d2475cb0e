"""DataFrame operators: sequences, model tables, lookups, generation."""
