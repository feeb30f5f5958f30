"""DataFrame-to-DataFrame operators. Everything here is lazy unless its docstring says otherwise."""
