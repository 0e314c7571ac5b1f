"""Plans: domain views over the star-schema tables and the query catalog."""
