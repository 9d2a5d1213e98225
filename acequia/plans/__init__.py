"""The stored tables, the questions asked of them, and the registered queries."""
