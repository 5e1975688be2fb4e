"""Sources: every reader returns the posting columns of ``schema.POSTING``."""
