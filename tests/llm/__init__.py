"""Tests of the operators on documents, pages, conversations and vectors."""
