"""Registered queries over the benchmark tables, each next to its ANSI-SQL twin."""
