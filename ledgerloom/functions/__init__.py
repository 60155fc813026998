"""Column functions: keys, names, coercions and the rule languages' arithmetic."""
