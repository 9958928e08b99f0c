"""Physical plans that several operators share."""
