"""quadrille: mining and linking the schemas of RDF quads with Spark."""
