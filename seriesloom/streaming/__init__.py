"""Incremental forms: windowed event counts with late data, and results merged batch by batch."""
