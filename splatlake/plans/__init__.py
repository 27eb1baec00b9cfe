"""Plans: options, the conversion from a splat table to a tile set, and the tile set's documents."""
