"""The operators on the driver's tables: a demo book, one query per operator, and the SQL each must agree with."""
