"""Training-corpus operators, one module each; nothing outside this folder imports them."""
