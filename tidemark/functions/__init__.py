"""Functions that several operators share."""
