"""Plans: whole queries put together from sources and operators, and their reports."""
