"""Column functions: text, vectors and numbers, all inside the JVM unless a docstring says otherwise."""
