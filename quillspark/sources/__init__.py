"""Where documents come from and go to, and scratch tables between stages."""
