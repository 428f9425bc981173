"""Rendering results: diagrams, documents, reports."""
