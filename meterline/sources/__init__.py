"""Reading and writing: files, tables, pages, profiles, results."""
