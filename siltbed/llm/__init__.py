"""Operators on document texts. Nothing else in the library imports this subpackage."""
