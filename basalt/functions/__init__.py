"""Types, scalar expressions and bit fields."""
