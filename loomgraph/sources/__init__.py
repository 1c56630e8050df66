"""Text files as DataFrames, and back."""
