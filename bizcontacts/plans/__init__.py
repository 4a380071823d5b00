"""Table jobs and the query register."""
