"""Page sources, stored tables and artefact sinks."""
