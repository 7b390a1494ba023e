"""Readers of RDF documents and tables, and writers."""
