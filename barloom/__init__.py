"""barloom: Spark jobs for multi-factor research on long panels of bars."""
