"""The library built from raw tables, and the registered queries with their SQL."""
