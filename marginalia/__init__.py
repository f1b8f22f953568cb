"""Evidence analytics over text tables, as plain DataFrame transformations."""
