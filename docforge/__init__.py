"""docforge: document-evidence analytics as set-oriented Spark plans."""
