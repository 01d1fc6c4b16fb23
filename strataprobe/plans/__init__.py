"""Plans of operators: tasks with named inputs and outputs, checked, run, and turned into a metadata record."""
