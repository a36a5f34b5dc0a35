"""DataFrame operators: reports, merge, upsert, projects, metrics and detail tables."""
