"""Operators for training data: names, containers, splitting, tokens, mixing, text repair.

Nothing outside this subpackage imports it.
"""
