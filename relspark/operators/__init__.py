"""DataFrame operators: joins, ranking, latest values, vocabularies, relationships."""
