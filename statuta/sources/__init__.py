"""Scans: regulation XML, chunk files, uploads and tables."""
