"""The declarative plan of a dataset: its manifest."""
