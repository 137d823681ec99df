"""Watch-list screening, entity resolution and ownership tracing as Spark plans."""
