"""Session settings, materialisation, and the four end-to-end analyses."""
