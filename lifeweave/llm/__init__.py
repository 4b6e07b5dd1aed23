"""Operators that prepare training data from the timeline's texts and media; nothing else in the library imports this."""
