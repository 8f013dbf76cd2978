"""Functions over columns and, with the same results, over Python values."""
