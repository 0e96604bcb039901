"""Tables and the views on them that play the grouped-sample data model."""
