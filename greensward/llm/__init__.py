"""Operators for building training data at scale; nothing else in the package imports this one."""
