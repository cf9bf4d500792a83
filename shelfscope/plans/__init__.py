"""Domain tables built from the test tables, and the SQL that checks queries."""
