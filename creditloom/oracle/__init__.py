"""ANSI SQL equivalents of the registered queries, used only to check results."""
