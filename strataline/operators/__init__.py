"""Relational operators of rules, recursion, replay and queries, as DataFrame transformations."""
