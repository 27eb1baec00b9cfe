"""Multi-resolution spatial tiling of very large splat tables on Spark."""
