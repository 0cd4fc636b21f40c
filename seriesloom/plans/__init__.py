"""The registered queries: operators applied to the tables, each with DuckDB SQL where SQL can express it."""
