"""Training-data pipeline operators: search, classifiers, formatting, archives, de-duplication,
tokenisation and decontamination. Nothing else in the library imports this subpackage."""
