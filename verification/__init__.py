"""The driver tables in the shapes of the flight model, the registered queries, and their SQL twins."""
