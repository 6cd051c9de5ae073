"""Relational and numerical operators over panels."""
