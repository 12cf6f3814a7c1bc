"""Reading and writing tables, media files and fetched bytes."""
