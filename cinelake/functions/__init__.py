"""Column functions: Column to Column, all of built-ins."""
