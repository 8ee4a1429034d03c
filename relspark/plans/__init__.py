"""The user-level jobs, built from the operators."""
