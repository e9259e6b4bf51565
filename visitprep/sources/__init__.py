"""Visit tables: adapters of other schemas, and generated ones."""
