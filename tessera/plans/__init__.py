"""Derived inputs and the query catalog."""
