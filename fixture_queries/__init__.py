"""Queries over the supplied tables, used for checks and timing."""
