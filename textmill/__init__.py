"""textmill: corpus curation, sequence preparation and evaluation analytics as Spark DataFrame programs."""
