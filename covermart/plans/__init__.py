"""Whole jobs: building the stored tables, a scoped snapshot, a batch of questions."""
