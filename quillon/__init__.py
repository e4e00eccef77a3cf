"""quillon: search and analytics over tables that mix columns, text, places and vectors."""
