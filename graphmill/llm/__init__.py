"""Operators that prepare source code and texts for training language models. Nothing else in the library imports this."""
