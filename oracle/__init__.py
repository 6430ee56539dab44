"""DuckDB SQL that recomputes every query from the shared test tables."""
