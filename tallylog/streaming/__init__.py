"""Files that grow."""
