"""Catalogue matching, stock reservation and text-corpus operators on PySpark."""
