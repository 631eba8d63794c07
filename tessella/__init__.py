"""Map-tile tilesets as Spark DataFrames: tile algebra, vector tiling and discovery."""
