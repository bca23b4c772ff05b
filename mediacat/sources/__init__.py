"""Where tables come from: schemas, files, gazetteers, label taxonomies and adapters."""
