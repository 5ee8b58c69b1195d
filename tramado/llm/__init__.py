"""Operators that prepare and audit training data. Nothing else in the library imports this subpackage."""
