"""Registered queries by area, each with the SQL that checks it."""

from aislewise.registry import basics, checks, large, people, products, releases, reports, share

MODULES = (basics, share, products, reports, people, checks, releases, large)
