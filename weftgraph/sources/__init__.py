"""Where atoms come from and go to."""
