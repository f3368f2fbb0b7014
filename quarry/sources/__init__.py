"""Readers of files, feeds and vocabularies, and loads that can be run again."""
