"""Training-data operations: search, packing, counting, sharding, archives, mixing and de-duplication."""
