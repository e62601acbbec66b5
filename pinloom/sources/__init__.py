"""Dictionary files and their preparation."""
