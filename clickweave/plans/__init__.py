"""Named queries over the test tables, and the SQL that each must equal."""
