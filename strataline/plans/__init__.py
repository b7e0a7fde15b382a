"""From a program to an evaluation plan."""
