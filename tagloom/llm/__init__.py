"""Operators for preparing training text; see the README of the repository for their methods."""
