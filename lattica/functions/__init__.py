"""Column functions: ordered collections held in arrays and maps, and scalars with zero-based, literal, ASCII semantics."""
