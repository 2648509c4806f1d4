"""Queries and the service facade."""
