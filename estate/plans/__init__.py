"""Plan shapes shared by the operators: top-k, hot-key joins, closures."""
