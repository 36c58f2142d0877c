"""Training-data pipeline operators at corpus scale; nothing else in the library imports this subpackage."""
