"""Stored access paths: they are built once, kept up, and read in part."""
