"""Column, row and table operators of the refinement engine."""
