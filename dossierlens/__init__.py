"""Which categories of a tagged article dump describe each document of a collection."""
