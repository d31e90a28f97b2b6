"""Text and hashing functions shared by the operators."""
