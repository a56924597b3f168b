"""Column functions over the store's values."""
