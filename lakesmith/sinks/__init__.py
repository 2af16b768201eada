"""Writers: the only modules that change storage."""
