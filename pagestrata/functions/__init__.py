"""Column expressions and the tag-soup reader."""
