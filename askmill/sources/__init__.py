"""Reading and writing: articles, configs, tables and their names."""
