"""Column functions: distances and the query language's function library."""
