"""Readers, writers and the synthetic extract."""
