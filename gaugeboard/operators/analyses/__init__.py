"""Business analyses over whole tables."""
