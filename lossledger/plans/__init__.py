"""Plans: star schema, reports, semantic layer, quality checks, outlook."""
