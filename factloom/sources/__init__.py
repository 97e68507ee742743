"""Where facts come from: tables, source trees, and interchange formats."""
