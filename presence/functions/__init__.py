"""Column functions: no I/O, no shuffles, no Python in the executors."""
