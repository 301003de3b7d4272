"""Document query languages compiled to DataFrame operations."""
