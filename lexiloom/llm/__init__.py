"""Operators for large training-data pipelines; nothing else in lexiloom imports them."""
