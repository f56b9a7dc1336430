"""Sources: CSV, any installed format with declared array fields, and the JSON column catalog."""
