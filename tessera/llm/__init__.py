"""Operators for large-scale language-model training data."""
