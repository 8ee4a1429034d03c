"""The engine's operators applied to the given tables, with the SQL each must agree with."""
