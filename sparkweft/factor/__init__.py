"""Factor graphs: tables of factors and values, robust losses, linearization and least-squares solvers."""
