"""Graph text formats."""
