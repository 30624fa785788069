"""Plan-level building blocks shared by the operators: materialised tables, prefix sums, graph loops."""
