"""viewloom: Spark jobs for the data side of multi-view 3D generation."""
