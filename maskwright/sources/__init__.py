"""Reading and writing documents of several formats."""
