"""Analytics over labelled volumes, triangle meshes and skeleton graphs, as DataFrames."""
