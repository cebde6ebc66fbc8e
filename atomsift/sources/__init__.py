"""Structure files and run artefacts as DataFrames."""
