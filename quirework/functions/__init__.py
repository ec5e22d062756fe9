"""Column functions: each takes and gives Columns, so that plans stay within code generation."""
