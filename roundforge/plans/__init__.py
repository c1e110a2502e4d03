"""Views over the test tables and the catalogue of queries with their SQL."""
