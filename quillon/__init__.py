"""quillon: a relational analytics engine expressed as Spark plans."""
