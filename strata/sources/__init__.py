"""Readers that turn files into one raw frame an entity."""
