"""Column expressions and numerical kernels. Kernels are pure functions of numpy arrays."""
