"""A PySpark engine for read, locus and assembly tables, expressed as DataFrame plans."""
