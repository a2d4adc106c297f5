"""Training-corpus operators; nothing outside this package imports it."""
