"""Registers, stage files and result files."""
