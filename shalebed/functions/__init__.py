"""Column builders: paths, truthiness, guards and the template function library."""
