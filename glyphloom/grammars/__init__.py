"""Ready-made grammars with typed projections."""
