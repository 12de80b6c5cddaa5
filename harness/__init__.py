"""Views over the test tables, their queries, and the SQL that checks them."""
