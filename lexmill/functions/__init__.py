"""Lexmill subpackage."""
