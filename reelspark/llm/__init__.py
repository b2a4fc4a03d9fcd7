"""Operators for training data: grouping, splitting, run collapsing, neighbours, tokens, leaks and abuse.

Nothing outside this subpackage imports it.
"""
