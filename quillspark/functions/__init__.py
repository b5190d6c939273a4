"""Column functions: string kernels, line predicates and line-local rules."""
