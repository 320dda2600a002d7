"""Relational operators that stay parallel when one key holds a large share of all rows."""
