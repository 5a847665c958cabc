"""End-to-end jobs made of operators."""
