"""Stage runs, derived views and the registered queries."""
