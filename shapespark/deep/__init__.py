"""A learned stand-in for costly distances and mappings, in numpy."""
