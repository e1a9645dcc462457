"""Operators for preparing training text: ten of them, each in its own module, with thin queries in ``queries``."""
