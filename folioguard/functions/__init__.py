"""Column expressions and small helpers shared by every operator."""
