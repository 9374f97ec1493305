"""Operators of a training-data pipeline over a ``documents`` table; nothing else in the library imports them."""
