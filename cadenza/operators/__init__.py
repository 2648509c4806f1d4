"""Similarity, feedback, selection and playlist operators."""
