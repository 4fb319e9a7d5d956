"""Plans: facts from documents, statistics from facts, and the registered queries with their SQL."""
