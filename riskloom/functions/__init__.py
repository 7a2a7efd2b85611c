"""Column functions: scalar expressions and aggregate builders."""
