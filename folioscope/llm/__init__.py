"""Operators that prepare training data from the document corpus. Nothing outside this package imports it."""
