"""Column functions and numpy helpers shared by the operators."""
