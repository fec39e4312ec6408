"""Cube operators, by family; each is a mixin of ``Cube``."""
