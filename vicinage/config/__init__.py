"""Vocabularies, taxonomy, regions, profile options."""
