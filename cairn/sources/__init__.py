"""Readers that turn files, databases and platform listings into asset rows."""
