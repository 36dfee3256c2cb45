"""Column expressions: geometry, cutoffs, bases and kernels. All stay inside code generation."""
