"""Expression semantics: an exact evaluator over terms, and a compiler to Spark columns."""
