"""Bar tables, registered queries and the flagship study."""
