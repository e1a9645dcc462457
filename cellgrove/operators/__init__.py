"""Operators on trees, meshes and fields."""
