"""Named queries: each a DataFrame plan over the given tables, most with an SQL twin."""
