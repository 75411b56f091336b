"""Relational operators over shops, listings, offers and events."""
