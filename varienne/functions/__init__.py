"""Column expressions: numeric guards, polynomial bases, hashed random numbers."""
