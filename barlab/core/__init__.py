"""Scale primitives: indexed blocks, halo windows, two-level running aggregates, carry scans."""
