"""Training-data operators at corpus scale.  Nothing outside this folder imports it."""
