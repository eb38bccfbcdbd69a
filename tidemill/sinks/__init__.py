"""Where results go: files, a results store, a message bus."""
