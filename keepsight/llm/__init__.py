"""Operators for preparing training text at scale. Nothing else in keepsight imports this subpackage."""
