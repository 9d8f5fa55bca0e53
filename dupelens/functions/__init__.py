"""Scalar functions: Column expressions, and Arrow functions where no built-in exists."""
