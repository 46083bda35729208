"""Relational and graph operators over papers, citations and projects."""
