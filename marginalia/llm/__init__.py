"""Operators that prepare source code, comments and documents as training data."""
