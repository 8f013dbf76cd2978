"""What questions are made of."""
