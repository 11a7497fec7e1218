"""Column-level building blocks: no shuffle, no Python in the row path."""
