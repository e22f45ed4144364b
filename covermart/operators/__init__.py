"""DataFrame-to-DataFrame operators over policies and their covered months."""
