"""End-to-end plans wired from the operators, and the registered queries."""
