"""Column expressions. Everything except ``text.fold_accents`` stays in the JVM."""
