"""Operators for preparing training text at scale; see the modules for each one's contract."""
