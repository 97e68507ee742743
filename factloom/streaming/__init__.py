"""Stateful streams over edits, requests and results."""
