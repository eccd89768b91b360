"""Physical-plan helpers shared by the operators: size-checked broadcast, salting, exact distributed ranking."""
