"""Column functions and dense numeric kernels."""
