"""The row-local pipeline over streams."""
