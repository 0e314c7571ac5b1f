"""Table-in / table-out analytical operators."""
