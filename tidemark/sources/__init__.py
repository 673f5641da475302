"""tidemark sources."""
