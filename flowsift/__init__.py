"""Network-flow preparation and detector evaluation as Spark DataFrame functions."""
