"""Composite work: fixture views, listing query, quality jobs, checks."""
