"""DataFrame operators: validate, look up, split, merge, jobs and code lists."""
