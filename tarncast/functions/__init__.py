"""Column builders: everything here is a JVM-side expression unless its docstring says otherwise."""
