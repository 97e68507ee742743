"""Whole programs: the fact store, the query facade, and the registered queries."""
