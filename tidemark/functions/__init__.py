"""tidemark functions."""
