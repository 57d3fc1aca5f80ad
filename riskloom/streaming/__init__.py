"""Event-time features and checks that run on static and streaming frames alike."""
