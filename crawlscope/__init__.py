"""Site and search analytics as Spark jobs: every operator takes and returns DataFrames keyed by site."""
