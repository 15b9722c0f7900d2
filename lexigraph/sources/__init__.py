"""Tables and stores."""
