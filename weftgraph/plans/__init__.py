"""Query languages, pattern algebra and its compiler."""
