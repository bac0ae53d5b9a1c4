"""Operators over symbol, embedding and edge tables."""
