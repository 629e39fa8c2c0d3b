"""Whole licence texts, one file each."""
