"""Column functions: curves, geometry, bit tricks, experiment names, byte codecs."""
