from tracefold.sources.tables import table, TABLES  # noqa: F401
