"""Price, offer and directory warehouse jobs as DataFrame transformations."""
