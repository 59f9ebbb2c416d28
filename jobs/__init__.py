"""Jobs over whole tables, each with a command line and a settings file beside it."""
