"""The cascade, the derived views and the registered queries."""
