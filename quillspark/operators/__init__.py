"""Relational operators over lines: scans with state, lists, tables, links, wrapping."""
