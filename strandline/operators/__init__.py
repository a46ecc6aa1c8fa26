"""Operators over ordered rows: masks, bundles, cut plans, lookups, matches, row profiles."""
