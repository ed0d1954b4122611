"""Relational and domain operators over panels."""
