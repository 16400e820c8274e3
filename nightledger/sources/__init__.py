"""Reading and writing landed events, the archive, exposure tables and configuration."""
