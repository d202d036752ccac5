"""Plans: operators put together end to end."""
