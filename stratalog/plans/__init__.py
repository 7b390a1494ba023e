"""Rule documents: model, grammar, analysis, and the planning of bodies as DataFrames."""
