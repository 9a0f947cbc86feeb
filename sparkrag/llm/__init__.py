"""Training-data operators; each module opN_<name> holds one operator and its query."""
