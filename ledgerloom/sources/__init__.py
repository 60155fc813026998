"""Readers and writers: instances, dictionaries, layouts, rules, logs and the star-schema tables."""
