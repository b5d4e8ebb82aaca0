"""Readers that turn files into record tables."""
