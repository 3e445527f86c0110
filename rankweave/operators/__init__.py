"""Reusable DataFrame -> DataFrame jobs."""
