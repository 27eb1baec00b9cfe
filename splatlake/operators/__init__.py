"""Operators over splat tables: k-d partition, level-of-detail roll-up, encoding."""
