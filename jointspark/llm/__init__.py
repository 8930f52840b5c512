"""Operators for preparing training text: ten self-contained modules, nothing else in the library imports them."""
