"""Plans: operators put together for whole batches of questions."""
