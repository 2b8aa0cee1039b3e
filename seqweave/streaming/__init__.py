"""No streaming operators: the sequences of this library are bounded and ordered by position."""
