"""Walk-forward strategy validation expressed as Spark plans."""
