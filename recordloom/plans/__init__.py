"""Named queries over the star-schema tables, each with an SQL statement of the same result."""
