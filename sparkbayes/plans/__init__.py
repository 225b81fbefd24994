"""Models as data, and the catalog of registered queries."""
