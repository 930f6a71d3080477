"""Plans that compose the operators, and the queries over the driver tables."""
