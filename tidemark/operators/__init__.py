"""tidemark operators."""
