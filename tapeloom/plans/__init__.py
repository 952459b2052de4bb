"""Searches, lookups and daily jobs, put together from the operators."""
