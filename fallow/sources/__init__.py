"""Reading and writing the panel's files and the fitted results."""
