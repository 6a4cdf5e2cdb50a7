"""The registered queries and the SQL that states what each must return."""
