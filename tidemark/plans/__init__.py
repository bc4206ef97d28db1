"""The control plane: semantics, routing, reports, the command line and the registered queries."""
