"""Queries a user asks for, composed from operators."""
