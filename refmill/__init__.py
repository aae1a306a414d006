"""Citation and bibliography auditing over large document collections, expressed as Spark plans."""
