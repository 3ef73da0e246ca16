"""Operators for training data: one module each, their queries in ``queries``."""
