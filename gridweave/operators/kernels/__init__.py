"""numpy kernels that run inside Arrow functions, one raster or polygon at a time."""
