"""tidemark streaming."""
