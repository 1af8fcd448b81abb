"""Example queries over the test tables, one per operator; importing the package fills the registry."""
