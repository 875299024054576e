"""Planning and bookkeeping of calls."""
