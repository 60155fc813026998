"""Relational operators over facts, layouts, rules and hierarchies."""
