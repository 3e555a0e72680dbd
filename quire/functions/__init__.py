"""Column functions: pure expressions over text, usable in any DataFrame or SQL plan."""
