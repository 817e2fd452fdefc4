"""Campaign analytics written as functions from DataFrame to DataFrame."""
