"""What plans need: written tables between iterations, and the registered queries with their SQL."""
