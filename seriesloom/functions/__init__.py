"""Column helpers that operators share."""
