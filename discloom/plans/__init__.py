"""The query catalogue and the plan objects of questions."""
