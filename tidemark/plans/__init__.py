"""tidemark plans."""
